"""Removal of text repeated from documents with smaller ids, by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id.

1. Where. Each window of LENGTH bytes has a minimiser, the least hash of its K-byte substrings: equal
   windows have equal minimisers, wherever they are. Neighbouring windows with one minimiser are a run.
   A run can only hold a repeat if its minimiser occurs twice. Tasks send each distinct minimiser of a
   chunk once, sorted and packed, so a string that is everywhere costs a row for each chunk.
2. What. The bytes of the runs that remain go to the bucket of their minimiser, where all occurrences of
   a window meet. Equal runs are settled before that and in the bucket, and only the first goes on.
3. Suffix array of a bucket, by two-stage sorting: only the suffixes smaller than their successors are
   sorted directly; the larger ones are induced by a scan of the buckets of first bytes from left to
   right. Adjacent common prefixes of LENGTH bytes or more make the classes of equal strings, and every
   member of a class after its smallest document is removed.
   A minimiser that is in HOT documents or more, such as one of a line that every document has, would be one
   group for one task. Its windows are dealt by their own 128-bit hashes instead, after each task has settled
   equal ones, so that even a window that is everywhere is one row for each chunk.
4. The removed intervals of a document are united and cut out.

Null texts are empty, and empty and short texts lose nothing; very long ones are cut as others are. Matches never cross
documents. Rows with a null doc_id neither remove nor lose anything. Rows that share a doc_id do not remove from one
another; repeated rows are returned each. Exact copies in one chunk are settled whole. An empty table gives no rows.
Other columns are not read, whatever their names. Sides are broadcast only after a check that they hold at most
BROADCAST_BYTES, and hot minimisers are at most HOT_MOST by their definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import dropped, forget, saved, text_of
from intervalia.llm.packing import by_bucket, mixed, pack, unpack

LENGTH = 50
K = 20
#: Text hashed at once, text of a chunk, and text for which a bucket is made.
BLOCK_BYTES, CHUNK_BYTES, BUCKET_BYTES = 1 << 20, 32 << 20, 16 << 20
BROADCAST_BYTES = 64 << 20
#: Documents that make a minimiser hot, documents of a chunk from which on it is counted, and hot ones at most.
HOT, HOT_CHUNK, HOT_MOST = 20_000, 8, 1 << 20
#: Text that is suffix-sorted at once.
SORT_BYTES = 1 << 20
SEPARATOR = 0xFF  # never part of UTF-8
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# minimisers


def words_le(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4 and 8 bytes from each position, as integers; a is padded with 16 bytes."""
    v = a.astype(np.uint64)
    v2 = v[:-1] | v[1:] << np.uint64(8)
    v4 = v2[:-2] | v2[2:] << np.uint64(16)
    return v4, v4[:-4] | v4[4:] << np.uint64(32)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, h
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - size :]) if size < width else m


def runs(texts: list[bytes], length: int = LENGTH, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its number, and minimiser, first and last window of each of its runs."""
    block, size = [], 0
    for i, t in enumerate(texts):
        if len(t) >= length:
            block.append(i)
            size += len(t)
        if size >= BLOCK_BYTES:
            yield from _block_runs([texts[j] for j in block], block, length, k)
            block, size = [], 0
    if block:
        yield from _block_runs([texts[j] for j in block], block, length, k)


def _block_runs(texts, numbers, length, k):
    a = np.frombuffer(b"".join(texts) + bytes(32), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - np.array([len(t) for t in texts])
    v4, v8 = words_le(a)
    n = int(ends[-1])
    h = mixed(v8[: n - k + 1] * _C[0] + v8[8 : n - k + 9] * _C[1] + v4[16 : n - k + 17] * _C[2])
    m = sliding_min(h, length - k + 1)
    for i, begin, end in zip(numbers, begins, ends):
        own = m[begin : end - length + 1]
        first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(own) - 1]))
        yield i, own[first], first, last


# suffix arrays


def words_be(a: np.ndarray) -> np.ndarray:
    """8 bytes from each position in big-endian order; zeros follow the end."""
    v = np.concatenate((a, np.zeros(8, np.uint8))).astype(np.uint64)
    v = v[:-1] << np.uint64(8) | v[1:]
    v = v[:-2] << np.uint64(16) | v[2:]
    return (v[:-4] << np.uint64(32) | v[4:])[: len(a)]


def smaller_than_next(a: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one, before nothing, is not."""
    change = np.flatnonzero(a[1:] != a[:-1])
    up = a[change] < a[change + 1]
    sizes = np.diff(np.concatenate(([-1], change, [len(a) - 1])))
    return np.repeat(np.concatenate((up, [False])), sizes)


def suffix_array(a: np.ndarray, depth: int = 56) -> np.ndarray:
    """Positions of a in the order of their suffixes, compared on at least depth bytes."""
    n = len(a)
    if n == 0:
        return np.zeros(0, np.int64)
    up = smaller_than_next(a)
    word = np.concatenate((words_be(a), np.zeros(depth + 8, np.uint64)))
    direct = np.flatnonzero(up)
    direct = direct[np.argsort(word[direct])]
    group = np.concatenate(([0], np.cumsum(word[direct][1:] != word[direct][:-1]))) if len(direct) else direct
    for at in range(8, depth, 8):
        same = np.zeros(len(direct) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[:-1] | same[1:])
        if not len(tied):
            break
        key, g = word[direct[tied] + at], group[tied]
        order = np.lexsort((key, g))
        direct[tied] = direct[tied][order]
        key = key[order]
        step = np.zeros(len(direct), np.int64)
        step[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(step)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[a[-1]].append(np.array([n - 1]))
    edges = np.searchsorted(a[direct], np.arange(257))
    out = []

    def induce(c: int, scanned: np.ndarray) -> None:
        p = scanned - 1
        p = p[p >= 0]
        p = p[~up[p] & (a[p] >= c)]
        order = np.argsort(a[p], kind="stable")
        p = p[order]
        first = a[p]
        cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(p) else []
        for x, y in zip(cuts, [*cuts[1:], len(p)]):
            larger[first[x]].append(p[x:y])

    for c in range(256):
        k = 0
        while k < len(larger[c]):  # scanning may add to the bucket that is scanned
            induce(c, larger[c][k])
            k += 1
        out += larger[c]
        larger[c] = []
        own = direct[edges[c] : edges[c + 1]]
        if len(own):
            induce(c, own)
            out.append(own)
    return np.concatenate(out)


def common_prefixes(a: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix in the order shares with the one before it, at most `most`; 0 for the first."""
    word = np.concatenate((words_be(a), np.zeros(most + 8, np.uint64)))
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, most, 8):
        x = word[order[live] + at] ^ word[order[live - 1] + at]
        out[live] += np.where(x == 0, 8, 0)
        part, y = live[x != 0], x[x != 0]
        for shift in range(56, 0, -8):
            hit = (y >> np.uint64(shift)) == 0
            out[part] += hit
        live = live[x == 0]
    # zeros follow the end of a, but do not belong to it
    return np.minimum(np.minimum(out, most), np.minimum(len(a) - order, np.concatenate(([0], len(a) - order[:-1]))))


def repeated(pieces: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(piece, begin, end) of the bytes of pieces in strings that a piece of a smaller owner holds."""
    a = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(a)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    # shorter suffixes run into a separator, so none stands between two equal strings
    order = order[order + length <= (begins + sizes)[piece[order]]]
    if not len(order):
        return []
    group = np.cumsum(common_prefixes(a, order, length) < length)
    owner = owners[piece[order]]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.concatenate((first, [len(order)]))))
    gone = np.zeros(len(a) + 1, bool)
    gone[order[owner > least]] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)))
    return [(int(piece[x]), int(x - begins[piece[x]]), int(y - 1 - begins[piece[x]] + length)) for x, y in zip(edge[::2], edge[1::2])]


# the distributed plan


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def _chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes], list]]:
    docs, texts, more, size = [], [], [], 0
    for b in batches:
        for doc, t, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            docs.append(doc)
            texts.append(raw)
            more.append(x)
            size += len(raw)
            if size >= most:
                yield docs, texts, more
                docs, texts, more, size = [], [], [], 0
    if docs:
        yield docs, texts, more


PARTS = "bucket int, kind int, data binary, text binary"
ALONE, KNOWN, GONE, PIECES, COMMON, WINDOWS = range(6)


def _part(bucket, kind, data, text=b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary()), pa.array([text], pa.binary())], names=["bucket", "kind", "data", "text"])


class SuffixDedup:
    def __init__(self, docs: DataFrame, length: int = LENGTH, hot: int = HOT):
        if length < K + 12:
            raise ValueError(f"length must be at least {K + 12}")
        self.spark, self.length, self.hot = docs.sparkSession, length, hot
        raw = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().alias("text"))
        self.rows = raw.withColumn("h", F.xxhash64("text"))

    def run(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (text of begin:end) of every row."""
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(least, total // BUCKET_BYTES + 1)
        # windows have a minimiser for each 16 bytes or so, so no more than HOT_MOST are in so many documents
        self.hot = max(self.hot, total // 16 // HOT_MOST)
        found = saved(self._candidates(), "suffix-candidates")
        common = [unpack(r[0], np.uint64)[0] for r in found.where(F.col("kind") == COMMON).select("data").collect()]
        self.common = np.sort(np.concatenate(common)) if common else np.zeros(0, np.uint64)
        wanted = saved(self._per_document(found.where(F.col("kind") == KNOWN), self._merge_wanted(), "doc long, runs binary"), "suffix-wanted")
        gone = self._gone(wanted).union(found.where(F.col("kind") == GONE).select("bucket", "data"))
        gone = saved(self._per_document(gone, self._merge_gone(), "doc long, h long, gone binary"), "suffix-gone")
        dropped(found, wanted)
        return self._cut(gone)

    def _beside(self, side: DataFrame, column: str) -> DataFrame:
        """The side, to be broadcast if it is small."""
        size = side.agg(F.sum(F.length(column) + 24)).first()[0] or 0
        return F.broadcast(side) if size <= BROADCAST_BYTES else side

    def _grouped(self, parts: DataFrame, f, schema: str) -> DataFrame:
        return parts.groupBy("bucket").applyInPandas(f, schema)

    def _candidates(self) -> DataFrame:
        """Runs whose minimiser occurs twice, packed by document bucket; whole copies as gone."""
        n, length, hot = self.buckets, self.length, self.hot

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for docs, texts, hashes in _chunks(batches, CHUNK_BYTES):
                least: dict[bytes, int] = {}
                for i, t in enumerate(texts):
                    key = hashlib.blake2b(t, digest_size=16).digest()
                    if len(t) >= length and (key not in least or docs[i] < docs[least[key]]):
                        least[key] = i
                kept = set(least.values())
                copies = [i for i, t in enumerate(texts) if len(t) >= length and i not in kept and docs[i] > docs[least[hashlib.blake2b(t, digest_size=16).digest()]]]
                if copies:
                    for b, cols in _spread([(docs[i], hashes[i], 0, len(texts[i])) for i in copies], n):
                        yield _part(b, GONE, pack(*cols))
                lost = set(copies)
                m_, d_, r_ = [], [], []
                for i, m, first, _ in runs([b"" if i in lost else t for i, t in enumerate(texts)], length):
                    m_.append(m >> np.uint64(16))
                    d_.append(np.full(len(m), docs[i], np.int64))
                    r_.append(np.arange(len(m), dtype=np.uint32))
                if not m_:
                    continue
                m, d, r = np.concatenate(m_), np.concatenate(d_), np.concatenate(r_)
                del m_, d_, r_
                order = np.argsort(m, kind="stable")
                m, d, r = m[order], d[order], r[order]
                new = np.concatenate(([True], m[1:] != m[:-1]))
                alone = new & np.concatenate((new[1:], [True]))
                twice = ~alone
                for b, (x, y) in by_bucket(d[twice] % n, n, d[twice], r[twice]):
                    yield _part(b, KNOWN, pack(x, y))
                first = new & twice
                start = np.flatnonzero(new)
                docs_of = np.add.reduceat(np.concatenate(([True], (m[1:] != m[:-1]) | (d[1:] != d[:-1]))), start) if len(m) else start
                many = docs_of >= min(HOT_CHUNK, hot)
                for b, (x, y) in by_bucket((m[start][many] % np.uint64(n)).astype(np.int64), n, m[start][many], docs_of[many]):
                    yield _part(b, COMMON, pack(x, y.astype(np.int64)))
                # a minimiser that is known to be repeated is sent without its place
                m, d, r = m[alone | first], np.where(alone, d, -1)[alone | first], np.where(alone, r, 0).astype(np.uint32)[alone | first]
                known = first[alone | first]
                # buckets by the low bits, so a sorted chunk is sorted in each of them
                for b, (x, y, z, k) in by_bucket((m % np.uint64(n)).astype(np.int64), n, m, d, r, known):
                    yield _part(b, ALONE, pack(np.diff(x, prepend=np.uint64(0)), y, z, k.astype(np.uint8)))

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            out = [(b, k, bytes(x)) for b, k, x in zip(group["bucket"], group["kind"], group["data"]) if k not in (ALONE, COMMON)]
            counted = [unpack(x, np.uint64, np.int64) for x, k in zip(group["data"], group["kind"]) if k == COMMON]
            if counted:
                m, at = np.unique(np.concatenate([x[0] for x in counted]), return_inverse=True)
                m = m[np.bincount(at, np.concatenate([x[1] for x in counted])) >= hot]
                if len(m):
                    out.append((group["bucket"].iloc[0], COMMON, pack(m)))
            sent = [unpack(x, np.uint64, np.int64, np.uint32, np.uint8) for x, k in zip(group["data"], group["kind"]) if k == ALONE]
            if sent:
                m = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in sent])
                d, r, known = (np.concatenate([x[c] for x in sent]) for c in (1, 2, 3))
                order = np.argsort(m, kind="stable")
                s = m[order]
                same = s[1:] == s[:-1]
                twice = np.zeros(len(m), bool)
                twice[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
                twice &= known == 0
                out += [(b, KNOWN, pack(x, y)) for b, (x, y) in by_bucket(d[twice] % n, n, d[twice], r[twice])]
            return pd.DataFrame(out, columns=["bucket", "kind", "data"])

        parts = self.rows.where("doc IS NOT NULL").select("doc", "text", "h").mapInArrow(scan, PARTS)
        return self._grouped(parts, meet, "bucket int, kind int, data binary")

    def _per_document(self, parts: DataFrame, merge, schema: str) -> DataFrame:
        return self._grouped(parts.select("bucket", "data"), merge, schema)

    @staticmethod
    def _merge_wanted():
        def merge(group: pd.DataFrame) -> pd.DataFrame:
            got = [unpack(x, np.int64, np.uint32) for x in group["data"]]
            d, r = (np.concatenate([x[c] for x in got]) for c in (0, 1))
            order = np.lexsort((r, d))
            d, r = d[order], r[order]
            cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            return pd.DataFrame({"doc": d[cuts], "runs": [pack(x) for x in np.split(r, cuts[1:])]}) if len(d) else pd.DataFrame({"doc": [], "runs": []})

        return merge

    @staticmethod
    def _merge_gone():
        def merge(group: pd.DataFrame) -> pd.DataFrame:
            got = [unpack(x, np.int64, np.int64, np.int64, np.int64) for x in group["data"]]
            d, h, x, y = (np.concatenate([g[c] for g in got]) for c in range(4))
            order = np.lexsort((x, h, d))
            d, h, x, y = d[order], h[order], x[order], y[order]
            rows = []
            cuts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))) if len(d) else []
            for a, b in zip(cuts, [*cuts[1:], len(d)]):
                upto = np.maximum.accumulate(y[a:b])
                new = np.concatenate(([True], x[a + 1 : b] > upto[:-1]))
                starts = np.flatnonzero(new)
                rows.append((d[a], h[a], pack(x[a:b][starts], upto[np.concatenate((starts[1:], [b - a])) - 1])))
            return pd.DataFrame(rows, columns=["doc", "h", "gone"])

        return merge

    def _gone(self, wanted: DataFrame) -> DataFrame:
        """Removed intervals, packed by document bucket."""
        n, length, common = self.buckets, self.length, self.common

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for docs, texts, more in _chunks(batches, CHUNK_BYTES // 4):
                held: dict[bytes, list] = {}
                done, extra = [], []
                for i, m, first, last in runs(texts, length):
                    ids, h = unpack(more[i]["runs"], np.uint32)[0], more[i]["h"]
                    ids = ids[ids < len(m)]
                    for b, x, y in zip((m[ids] >> np.uint64(16)).tolist(), first[ids].tolist(), last[ids].tolist()):
                        piece = texts[i][x : y + length]
                        was = held.get(piece)
                        if was is None:
                            held[piece] = [b, docs[i], h, x]
                        elif was[1] == docs[i]:
                            extra.append((piece, b, docs[i], h, x))
                        elif was[1] < docs[i]:
                            done.append((docs[i], h, x, x + len(piece)))
                        else:
                            done.append((was[1], was[2], was[3], was[3] + len(piece)))
                            was[:] = [b, docs[i], h, x]
                # repeats inside the document that held a piece when a smaller one came are settled there
                for piece, b, d, h, x in extra:
                    if held[piece][1] < d:
                        done.append((d, h, x, x + len(piece)))
                extra = [e for e in extra if held[e[0]][1] == e[2]]
                hot, each = [], {}
                everywhere = set(common.tolist())
                for piece, b, d, h, x in [*((piece, *rest) for piece, rest in held.items()), *extra]:
                    (hot if b in everywhere else each.setdefault(b % n, [])).append((piece, b, d, h, x))
                if hot:
                    known = _windows(hot, length)
                    lost = _later(*known)
                    done += _stretches(*[x[lost] for x in known[2:]], length)
                    for b, cols in by_bucket((known[0][~lost] % np.uint64(n)).astype(np.int64), n, *[x[~lost] for x in known]):
                        yield _part(b, WINDOWS, pack(*cols))
                if done:
                    for b, cols in _spread(done, n):
                        yield _part(b, GONE, pack(*cols))
                for b, rows in each.items():
                    pieces, m, d, h, x = zip(*rows)
                    yield _part(b, PIECES, pack(*[np.array(c, np.int64) for c in (m, d, h, x, [len(p) for p in pieces])]), b"".join(pieces))

        def sort(group: pd.DataFrame) -> pd.DataFrame:
            out = [(int(b), bytes(x)) for b, k, x in zip(group["bucket"], group["kind"], group["data"]) if k == GONE]
            sent = [(unpack(x, *[np.int64] * 5), text) for k, x, text in zip(group["kind"], group["data"], group["text"]) if k == PIECES]
            if sent:
                rows = list(_settled(sent, length))
                if rows:
                    out += [(b, pack(*cols)) for b, cols in _spread(rows, n)]
            sent = [unpack(x, np.uint64, np.uint64, *[np.int64] * 3) for k, x in zip(group["kind"], group["data"]) if k == WINDOWS]
            if sent:
                known = [np.concatenate([x[c] for x in sent]) for c in range(5)]
                lost = _later(*known)
                rows = _stretches(*[x[lost] for x in known[2:]], length)
                if rows:
                    out += [(b, pack(*cols)) for b, cols in _spread(rows, n)]
            return pd.DataFrame(out, columns=["bucket", "data"])

        side = self._beside(wanted, "runs")
        rows = self.rows.join(side, "doc").select("doc", "text", F.struct("h", "runs").alias("more"))
        return self._grouped(rows.mapInArrow(cut, PARTS), sort, "bucket int, data binary")

    def _cut(self, gone: DataFrame) -> DataFrame:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for b in batches:
                rows = []
                for doc, t, g in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    raw = t.as_buffer().to_pybytes()
                    x, y = unpack(g.as_py(), np.int64, np.int64) if g.is_valid else (np.zeros(0, np.int64),) * 2
                    edge = [0, *np.column_stack((x, y)).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[p:q] for p, q in zip(edge[::2], edge[1::2]))
                    rows.append((doc, len(raw), len(raw) - len(kept), len(x), hashlib.sha256(kept).hexdigest(), ",".join(f"{p}:{q}" for p, q in zip(x.tolist(), y.tolist()))))
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        side = self._beside(gone, "gone")
        rows = self.rows.join(side, ["doc", "h"], "left").select("doc", "text", "gone")
        return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def _settled(sent: list, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Removed intervals (doc, h, begin, end) of the pieces of a bucket.

    Equal pieces of different tasks are settled at once, as within a task; a piece that is left alone with
    its minimiser has no equal window elsewhere. The others are suffix-sorted, so many minimisers at a
    time as SORT_BYTES hold; the pieces of one minimiser stay together.
    """
    m, d, h, x = (np.concatenate([cols[c] for cols, _ in sent]) for c in range(4))
    texts = []
    for cols, text in sent:
        at = np.concatenate(([0], np.cumsum(cols[4]))).tolist()
        texts += [text[a:b] for a, b in zip(at, at[1:])]
    held: dict[bytes, int] = {}
    live = np.ones(len(texts), bool)
    for i in np.argsort(d, kind="stable").tolist():
        j = held.setdefault(texts[i], i)
        if d[j] < d[i]:
            live[i] = False
            yield int(d[i]), int(h[i]), int(x[i]), int(x[i]) + len(texts[i])
    order = np.flatnonzero(live)
    order = order[np.argsort(m[order], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], m[order][1:] != m[order][:-1])))
    size, cut, batch = 0, [], []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        own = order[a:b]
        if b - a > 1 and len(np.unique(d[own])) > 1:
            cut.append(own)
            size += sum(len(texts[i]) for i in own.tolist())
            if size >= SORT_BYTES:
                batch.append(np.concatenate(cut))
                size, cut = 0, []
    if cut:
        batch.append(np.concatenate(cut))
    for own in batch:
        for p, a, b in repeated([texts[i] for i in own.tolist()], d[own], length):
            i = own[p]
            yield int(d[i]), int(h[i]), int(x[i]) + a, int(x[i]) + b


def _windows(pieces: list[tuple], length: int) -> list[np.ndarray]:
    """Two hashes, doc, h and place of every window of the pieces (text, minimiser, doc, h, place)."""
    sizes = np.array([len(p[0]) for p in pieces])
    a = np.frombuffer(b"".join(p[0] for p in pieces) + bytes(16), np.uint8)
    v8 = words_le(a)[1]
    n = sizes - length + 1
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + inside
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        one = mixed(one ^ v8[at + k] * _C[0])
        two = mixed(two * _C[1] + v8[at + k])
    d, h, x = (np.repeat(np.array([p[c] for p in pieces], np.int64), n) for c in (2, 3, 4))
    return [one, two, d, h, x + inside]


def _later(one: np.ndarray, two: np.ndarray, d: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether an equal window has a smaller document."""
    order = np.lexsort((d, two, one))
    new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))[: len(order)]
    first = np.flatnonzero(new)
    out = np.zeros(len(d), bool)
    out[order] = d[order] > np.repeat(d[order][first], np.diff(np.append(first, len(order))))
    return out


def _stretches(d: np.ndarray, h: np.ndarray, x: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(doc, h, begin, end) of windows that begin at x, neighbours as one."""
    order = np.lexsort((x, h, d))
    d, h, x = d[order], h[order], x[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (x[1:] > x[:-1] + 1)))[: len(d)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1 if len(first) else first
    return list(zip(d[first].tolist(), h[first].tolist(), x[first].tolist(), (x[last] + length).tolist()))


def _spread(rows: list[tuple], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    cols = [np.array(c, np.int64) for c in zip(*rows)]
    order = np.lexsort((cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    yield from by_bucket(cols[0] % n, n, *cols)


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row of docs (doc_id, text)."""
    return SuffixDedup(docs, length, hot).run()
