"""Periodic runs of words, by the runs theorem.

Every run holds a Lyndon root of its period, and that root is the longest Lyndon word at its start under one of two
opposite orders of the alphabet. So the words of a document become numbers, their suffixes are sorted, and the longest
Lyndon word at every place ends at the next smaller value of the inverse suffix array, under the opposite order at the
next larger one. Roots in a row are extended to both sides by the longest common prefix of two suffixes, and of
two prefixes by the same over the words in reverse: each is the least of a range of the array of adjacent common prefixes, looked up in a sparse table.
The table is built level by level, and each level answers the ranges of its size before the next one replaces it.

Documents are handled in groups of about GROUP words with a separator of its own after each, a long one by itself. A
group goes to the second step with those documents alone that have as many like roots in a row as a wanted run has.

A run is maximal, has its smallest period, at least `least` words and at least `times` periods, two or more. Words are `[^\\x20\\x09-\\x0D]+`.
Null, blank and empty texts have no words and no run. Very long texts are searched whole, one at a time. Every row is
searched by itself, repeated ones too. Null doc_ids stay null. An empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from intervalia.llm.common import text_of

#: Words of the documents that are handled together.
GROUP = 1 << 17
LEAST, TIMES = 24, 3


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of x, whose values are not negative, and the place of each in it, by doubling.

    Suffixes whose place is settled are not sorted again.
    """
    n = len(x)
    order = np.argsort(x)
    place = np.empty(n, np.int64)

    def settle(part: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Gives suffixes sorted by keys the place of the first with the same key; returns which share theirs."""
        new = np.ones(len(part), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        place[part] = base[first][group]
        return np.diff(np.append(first, len(part)))[group] > 1

    at = np.arange(n)
    shared = settle(order, x[order], at)
    at, open_ = at[shared], order[shared]
    size = 1
    while len(open_):
        ahead = open_ + size
        # a suffix that ends sooner is smaller; places are below n
        keys = place[open_] * (n + 1) + np.where(ahead < n, place[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(keys)
        open_ = open_[by]
        order[at] = open_
        shared = settle(open_, keys[by], at)
        at, open_ = at[shared], open_[shared]
        size *= 2
    return order, place


def adjacent_prefixes(x: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it."""
    out, n, length = [0] * len(x), len(x), 0
    words, where = x.tolist(), place.tolist()
    previous = np.empty(n, np.int64)
    previous[order[1:]] = order[:-1]
    if n:
        previous[order[0]] = -1
    for i, j in enumerate(previous.tolist()):
        if j < 0:
            length = 0
            continue
        stop = n - max(i, j)
        while length < stop and words[i + length] == words[j + length]:
            length += 1
        out[where[i]] = length
        if length:
            length -= 1
    return np.array(out, np.int64)


def common_prefixes(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes of x at a and at b, which differ; the length of x is an empty suffix."""
    n = len(x)
    out = np.zeros(len(a), np.int64)
    inside = np.flatnonzero((a < n) & (b < n))
    if not len(inside):
        return out
    order, place = suffix_array(x)
    level = adjacent_prefixes(x, order, place)
    p, q = place[a[inside]], place[b[inside]]
    lo, hi = np.minimum(p, q) + 1, np.maximum(p, q)
    depth = np.frexp(hi - lo + 1)[1] - 1
    for k in range(int(depth.max()) + 1):
        now = depth == k
        out[inside[now]] = np.minimum(level[lo[now]], level[hi[now] - (1 << k) + 1])
        if len(level) > 1 << k:
            level = np.minimum(level[: -(1 << k)], level[1 << k :])
    return out


def lyndon_ends(place: list[int], stops: list[int]) -> tuple[list[int], list[int]]:
    """Next place with a smaller, and with a larger value; none crosses the separators at stops, which are the smallest values.

    Where no larger value comes before the separator the place itself is returned: what is left need not be a Lyndon word then,
    and runs to the end of a document have their roots under the first order.
    """
    n = len(place)
    smaller, larger = list(range(n)), list(range(n))
    begin = 0
    for stop in stops:
        low, high = [], []
        for i in range(begin, stop):
            v = place[i]
            while low and place[low[-1]] > v:
                smaller[low.pop()] = i
            low.append(i)
            while high and place[high[-1]] < v:
                larger[high.pop()] = i
            high.append(i)
        for i in low:
            smaller[i] = stop
        begin = stop + 1
    return smaller, larger


def joined(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents one after the other with a separator of its own after each, below all words; places of the separators."""
    d = len(documents)
    x = np.concatenate([y for k, w in enumerate(documents) for y in (w + d, [k])]).astype(np.int64)
    return x, np.cumsum([len(w) + 1 for w in documents]) - 1


def roots(x: np.ndarray, stops: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of longest Lyndon words under either order, with the first root of every wanted run.

    A run of m words and period q holds at least (m - q + 1) // q roots in a row from its first one. A Lyndon word of length q
    is left out if the last or the middle one of as many does not have its length, first, middle and last word.
    """
    _, place = suffix_array(x)
    starts, lengths, at = [], [], np.arange(len(x))
    for ends in lyndon_ends(place.tolist(), stops.tolist()):
        size = np.array(ends, np.int64) - at
        i = np.flatnonzero(size)
        q = size[i]
        more = (np.maximum(least, times * q) - q + 1) // q - 1
        for share in (1, 2):
            other = i + (more + share - 1) // share * q
            inside = other < len(x)
            i, q, more, other = i[inside], q[inside], more[inside], other[inside]
            same = size[other] == q
            i, q, more, other = i[same], q[same], more[same], other[same]
            same = (x[i] == x[other]) & (x[i + q // 2] == x[other + q // 2]) & (x[i + q - 1] == x[other + q - 1])
            i, q, more = i[same], q[same], more[same]
        starts.append(i)
        lengths.append(q)
    return np.concatenate(starts), np.concatenate(lengths)


def periodic(documents: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of the runs of each document, by start, then period; words are numbers of 0 or more."""
    out: list[list] = [[] for _ in documents]
    # a document below the least length has no run
    held = [k for k, w in enumerate(documents) if len(w) >= least]
    if not held:
        return out
    x, stops = joined([documents[k] for k in held])
    start, size = roots(x, stops, least, times)
    if not len(start):
        return out
    # again with the documents that have candidates alone
    of = np.searchsorted(stops, start)
    some, of = np.unique(of, return_inverse=True)
    begins = stops - np.array([len(documents[k]) for k in held])
    start = start - begins[some][of]
    held = [held[k] for k in some]
    x, stops = joined([documents[k] for k in held])
    begins = stops - np.array([len(documents[k]) for k in held])
    start = start + begins[of]
    right = common_prefixes(x, start, start + size)
    n = len(x)
    # the words before a place, read backwards, are a suffix of the reverse
    left = common_prefixes(x[::-1].copy(), n - start, n - start - size)
    begin, length = start - left, left + size + right
    good = (length >= least) & (length >= times * size)
    found = np.unique(np.stack([of[good], begin[good] - begins[of[good]], length[good], size[good]], 1), axis=0)
    for k, a, m, q in found.tolist():
        out[held[k]].append((a, m, q))
    for r in out:
        r.sort(key=lambda t: (t[0], t[2]))
    return out


def numbered(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """Words as numbers, the same for the same word while seen lasts; any order of the alphabet serves."""
    new = set(words).difference(seen)
    if new:
        seen.update(zip(new, range(len(seen), len(seen) + len(new))))
    return np.array([seen[w] for w in words], np.int64)


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run has after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for a, m, q in found:
        change[a + q] += 1
        change[a + m] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods; of equals the first, then the shortest period."""
    return max(found, key=lambda t: (Fraction(t[1], t[2]), -t[0], -t[2]), default=None)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the hash of its doc_id repeats a part of itself to its end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def _searched(docs: DataFrame, report, schema: str, change=None, least: int = LEAST, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """report(doc_id, words, runs) gives a tuple of schema for every row of docs; change(doc_id, words) comes before."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows(held: list) -> pa.RecordBatch:
        seen: dict[bytes, int] = {}
        found = periodic([numbered(words, seen) for _, words in held], least, times)
        columns = list(zip(*[report(k, words, r) for (k, words), r in zip(held, found)]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                # bytes.split() cuts at space and U+0009 to U+000D alone
                key, words = key.as_py(), text.as_py().encode().split()
                if held and size + len(words) > group:
                    yield rows(held)
                    held, size = [], 0
                held.append((key, change(key, words) if change else words))
                size += len(words) + 1
        if held:
            yield rows(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(search, schema)


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id and the runs of every row of docs (doc_id, text), with start, length and period in words."""


    def report(doc_id, words, found):
        return doc_id, [{"start": a, "length": m, "period": q} for a, m, q in found]

    return _searched(docs, report, "doc_id long, runs array<struct<start:long,length:long,period:long>>", None, least, times)


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id and text of every row of docs with one period left of each run, words parted by one space."""
    return _searched(docs, lambda k, words, found: (k, b" ".join(kept_words(words, found)).decode()), "doc_id long, text string", None, least, times)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame, change=planted, group: int = GROUP) -> DataFrame:
    """Number of runs, the strongest run and digests of all runs and of the collapsed text of every row of docs."""

    def report(doc_id, words, found):
        best = strongest(found)
        most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return doc_id, len(found), *most, digest(b"".join([b"%d,%d,%d\n" % r for r in found])), digest(b" ".join(kept_words(words, found)))

    return _searched(docs, report, DIGESTS, change, group=group)
