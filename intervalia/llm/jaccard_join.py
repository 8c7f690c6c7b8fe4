"""Exact n-gram Jaccard join in metric space.

Sets of word shingles are compared by their symmetric difference D(A, B): A and B link if
(q + p) * D <= (q - p) * (|A| + |B|) for a similarity of p/q, which is the same as Jaccard >= p/q. D is a
metric, and so is what is left of it in a region of the space.

Peeling. A set that links with anything misses at most n - ceil(p * n / q) of its shingles in that partner, so at
most so many of them may be in no other set of the corpus: this is its distance to the union of all others.
Tasks count shingles that another distinct set has, from a share of the hash range (SHARE; bound and result are
exact for any share), in blocks by bucket; a shingle that is common in a task is sent once from it. Sets beyond
the bound are alone. What remains are copies, near copies and documents made of shared passages.

Pivots and regions. The first pivot is the empty set; every document is its set of differences from it. The
differences of a family are put in one order, the rarest first. What only one member has comes first of all and
counts as distance. By the triangle inequality two members within reach have their first common difference in
the first (q - p) / p * n + 1 places of both, (1 - p/q) * n + 1 below the empty set, and what is before it, with the
difference of what is left, is at most the reach of the pair. So every document is replicated to the regions of
these differences only, and only where the members' places leave it a partner.

Recursion. Each region elects centres, sets of its members that are not much larger than its smallest, and these
are compared with all of them. Regions whose members are one component by now are closed; those with at
most CAP members outside their largest component give their pairs, which are compared exactly. The larger ones
become families with their centre as pivot (regions with the same centre are one family): a member is now its
symmetric difference with the pivot. Members so close to the pivot that the triangle inequality alone links them
are linked to the closest; others must share a difference, so the family is dealt into regions as above, and
copies that only have the pivot in common fall apart. The last of LEVELS has no CAP, so that the join is exact.

Documents with equal sets are one node, named by a 64-bit fingerprint, and shingles are compared as 64-bit
hashes: the chance of any error is about (sets^2 + shingle pairs compared) / 2^64.

Components only. Pairs whose documents are known to be in one component are not compared, as all pairs of a large
group of near copies are the square of the group; links are therefore not listed or counted.

Null, blank and empty texts have no shingles and are linked with nothing; very long texts are sets like others, one
of which is in a task's memory at a time with a chunk of the rest. Rows with a null doc_id are returned with
themselves as (null) component and link nothing. Rows that share a doc_id are rows of one document each, under the
same name, whatever their texts: their component is the smallest that a link of their own set reaches. Ties fall to
the smaller doc_id. An empty table gives an empty result. Columns beside key and text are not read by join() and
kept by keep(), whatever their names. Broadcast sides are checked to be at most BROADCAST_ROWS rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from intervalia.llm.common import dropped, forget, rows_of, saved, text_of
from intervalia.llm.graph import components
from intervalia.llm.packing import GOLDEN, by_bucket, mixed, pack, unpack

WIDTH = 5
#: The similarity as a fraction: 75 of 100.
SIMILAR = (3, 4)
#: Members of a region outside its largest component up to which its pairs are compared.
CAP = 32
#: Levels of the recursion, and centres that a region elects at each.
LEVELS, CENTRES = 5, 3
#: Share of the hash range by which sets are peeled, as a right shift of 64 bits.
SHARE = 1
#: Text of a chunk of a task, and shingles for which a bucket is made.
CHUNK_BYTES, BUCKET_ROWS = 8 << 20, 1 << 20
BROADCAST_ROWS = 1_000_000
#: Sets that are compared with one set in one task.
SQUARE = 1024

_M1 = np.uint64(0xBF58476D1CE4E5B9)


def _numbers(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 40)) * GOLDEN) | np.uint64(1)


_ORDER = _numbers(64, 3)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8, A-Z in lower case.

    bytes.split() cuts at space and U+0009 to U+000D alone.
    """
    words = raw.lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than width are one shingle."""
    w = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _ORDER[i]
    h = mixed(h + np.uint64(k))
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def fingerprint(s: np.ndarray) -> int:
    sums = np.array([(s * GOLDEN).sum(dtype=np.uint64)]) + np.array([mixed(s).sum(dtype=np.uint64)]) * _M1
    return int(mixed(sums).view(np.int64)[0])


class JaccardJoin:
    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR, cap: int = CAP, levels: int = LEVELS, chunk_bytes: int = CHUNK_BYTES, share: int = SHARE):
        self.docs = docs.select(F.col(key).cast("long").alias("doc"), text_of(text).alias("text"))
        self.width, self.cap, self.levels, self.chunk_bytes, self.share = width, cap, levels, chunk_bytes, share
        self.p, self.q = similar
        self.spark = docs.sparkSession

    @property
    def partitions(self) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    # sets

    def members(self) -> DataFrame:
        """doc, n, m and set of every row: size, shingles in the share, and fingerprint (null if empty)."""
        width, share = self.width, self.share

        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for b in batches:
                n, m, f = [], [], []
                for t in b.column(1):
                    s = shingle_set(t.as_py(), width)
                    n.append(len(s))
                    m.append(len(_shared(s, share)))
                    f.append(fingerprint(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(f, pa.int64())], names=["doc", "n", "m", "set"])

        return self.docs.mapInArrow(each, "doc long, n long, m long, set long")

    def counted(self, total: int) -> DataFrame:
        """k and c: shingles in the share that another distinct set has too, by set; sets without any are left out.

        Hashes are compared by 48 bits of their own, so c may be too large by chance, which peels less.
        """
        width, share, most = self.width, self.share, self.chunk_bytes
        n = int(max(self.partitions, (total >> share) // BUCKET_ROWS + 1))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for sets, names in _chunks(batches, most, width):
                if not sets:
                    continue
                part = [_shared(s, share) >> np.uint64(16 - share) for s in sets]
                v, i = np.concatenate(part), np.repeat(np.arange(len(part), dtype=np.uint32), [len(x) for x in part])
                if not len(v):
                    continue
                order = np.argsort(v, kind="stable")
                v, i = v[order], i[order]
                new = np.concatenate(([True], v[1:] != v[:-1]))
                alone = new & np.concatenate((new[1:], [True]))
                k = np.array(names, np.int64)
                c = np.bincount(i[~alone], minlength=len(k))
                for b, (x, y) in by_bucket(k[c > 0] % n, n, k[c > 0], c[c > 0]):
                    yield _part(b, 1, pack(x, y))
                # what is common in the chunk goes once, without its sets
                v, i = v[new], np.where(alone, i, np.uint32(len(k)))[new]
                k = np.append(k, 0)
                for b, (x, y) in by_bucket((v % np.uint64(n)).astype(np.int64), n, v, i):
                    used, at = np.unique(y, return_inverse=True)
                    yield _part(b, 0, pack(np.diff(x, prepend=np.uint64(0)), at.astype(np.uint32)), pack(k[used], (used == len(k) - 1).astype(np.int8)))

        def meet(group: pa.Table) -> pa.Table:
            rows = list(zip(*[group.column(c).to_pylist() for c in ("bucket", "kind", "data", "names")]))
            out = [(b, x) for b, kind, x, _ in rows if kind]
            v, k, known = [], [], []
            for _, kind, x, y in rows:
                if not kind:
                    d, at = unpack(x, np.uint64, np.uint32)
                    names, common = unpack(y, np.int64, np.int8)
                    v.append(np.cumsum(d, dtype=np.uint64))
                    k.append(names[at])
                    known.append(common[at])
            if v:
                v, k, known = np.concatenate(v), np.concatenate(k), np.concatenate(known)
                order = np.argsort(v, kind="stable")
                s = v[order]
                same = s[1:] == s[:-1]
                order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
                if len(order):
                    order = order[np.lexsort((k[order], v[order]))]
                    v, k, known = v[order], k[order], known[order]
                    once = np.concatenate(([True], (v[1:] != v[:-1]) | (k[1:] != k[:-1]) | (known[1:] != known[:-1])))
                    v, k, known = v[once], k[once], known[once]
                    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
                    size = np.diff(np.append(first, len(v)))
                    held = np.repeat((size > 1) | (np.maximum.reduceat(known, first) > 0), size) & (known == 0)
                    k, c = np.unique(k[held], return_counts=True)
                    out += [(b, pack(x, y)) for b, (x, y) in by_bucket(k % n, n, k, c)]
            return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "data": pa.array([x[1] for x in out], pa.binary())})

        def add(group: pa.Table) -> pa.Table:
            got = [unpack(x, np.int64, np.int64) for x in group.column("data").to_pylist()]
            k, c = (np.concatenate([x[j] for x in got]) for j in (0, 1))
            name, at = np.unique(k, return_inverse=True)
            return pa.table({"k": name, "c": np.bincount(at, c).astype(np.int64)})

        parts = self.docs.where("doc IS NOT NULL").select("text").mapInArrow(scan, "bucket int, kind int, data binary, names binary")
        met = parts.groupBy("bucket").applyInArrow(meet, "bucket int, data binary")
        return met.groupBy("bucket").applyInArrow(add, "k long, c long")

    def sets_of(self, named: DataFrame) -> DataFrame:
        """k, n and items of the sets k of named (doc, k)."""
        width = self.width

        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    b = batch.slice(at, 256)
                    names, sizes, items = [], [], []
                    for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                        s = shingle_set(t.as_py(), width)
                        if len(s) and fingerprint(s) == k:  # rows of one doc_id may have other texts
                            names.append(k)
                            sizes.append(len(s))
                            items.append(s.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), _lists(items)], names=["k", "n", "items"])

        found = self.docs.join(self.beside(named), "doc").select("k", "text")
        return found.mapInArrow(each, "k long, n long, items array<long>").dropDuplicates(["k"])

    def beside(self, side: DataFrame) -> DataFrame:
        """The side, to be broadcast while it has few rows."""
        return F.broadcast(side) if rows_of(side) <= BROADCAST_ROWS else side

    # comparison

    def met(self, pairs: DataFrame, f, schema: str) -> DataFrame:
        """f(a, set of a, b, set of b) for the pairs (a, b), in tasks that hold one set a and a batch of sets b.

        A set a with many pairs is dealt to as many tasks as SQUARE sets each need.
        """
        tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / SQUARE).cast("int").alias("t"))
        dealt = pairs.join(tasks, "a").withColumn("z", F.pmod(F.xxhash64("b"), "t").cast("int"))
        sets = self.sets.select(F.col("k").alias("b"), "items")
        other = dealt.select("a", "z", "b").join(sets, "b").select("a", "z", F.lit(1).alias("role"), "b", "items")
        own = dealt.select("a", "z").distinct().join(sets.withColumnRenamed("b", "a"), "a").select("a", "z", F.lit(0).alias("role"), F.col("a").alias("b"), "items")
        rows = own.union(other).repartition(self.partitions, "a", "z").sortWithinPartitions("a", "z", "role")

        def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = None
            for batch in batches:
                items = batch.column("items")
                flat, ends = items.values.to_numpy().view(np.uint64), items.offsets.to_numpy()
                pairs_ = []
                for j, (a, role, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("a", "role", "b")])):
                    s = flat[ends[j] : ends[j + 1]]
                    if role == 0:
                        base = s.copy()
                    else:
                        pairs_.append((a, base, b, s))
                yield from f(pairs_)

        return rows.mapInArrow(stream, schema)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        p, q = self.p, self.q

        def compare(pairs_):
            a_, b_ = [], []
            for a, s, b, t in pairs_:
                if q * min(len(s), len(t)) >= p * max(len(s), len(t)):
                    common = _common(s, t)
                    if q * common >= p * (len(s) + len(t) - common):
                        a_.append(a)
                        b_.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])

        return self.met(pairs, compare, "a long, b long")

    def differences(self, pairs: DataFrame) -> DataFrame:
        """f, x, n, d and items of each pair (a, b): its pivot, member, size, distance and symmetric difference."""

        def differ(pairs_):
            for at in range(0, len(pairs_), 256):
                part = pairs_[at : at + 256]
                items = [np.setxor1d(s, t, assume_unique=True).view(np.int64) for _, s, _, t in part]
                cols = [pa.array(c, pa.int64()) for c in ([x[0] for x in part], [x[2] for x in part], [len(x[3]) for x in part], [len(i) for i in items])]
                yield pa.RecordBatch.from_arrays([*cols, _lists(items)], names=["f", "x", "n", "d", "items"])

        return self.met(pairs, differ, "f long, x long, n long, d long, items array<long>")

    def close(self, family: DataFrame) -> DataFrame:
        """Links (a, b) of members that the triangle inequality alone links through their pivot."""
        g = ((self.p + self.q) * F.col("d") - (self.q - self.p) * F.col("n")).alias("g")
        each = family.select("f", "x", g)
        own = family.select("f").distinct().join(self.sets.select(F.col("k").alias("f"), "n"), "f")
        each = each.union(own.select("f", F.col("f").alias("x"), (-(self.q - self.p) * F.col("n")).alias("g")))
        least = each.groupBy("f").agg(F.min(F.struct("g", "x")).alias("l")).select("f", F.col("l.g").alias("lg"), F.col("l.x").alias("a"))
        return each.join(least, "f").where("g + lg <= 0 AND x <> a").select("a", F.col("x").alias("b")).distinct()

    # regions

    def regions(self, family: DataFrame, root: bool) -> DataFrame:
        """f, e, x, n, g, reach: the regions of every member of every family, those where it may have a partner.

        family has f, x, n, d (the number of items) and items. Members with more differences of their own than
        any partner allows are peeled. For members x and y whose first common difference is in the region, with
        i and j differences before it, D(x, y) is at least i + j + |(d_x - i) - (d_y - j)|; so they are within reach
        only if g_y <= reach_x and g_x <= reach_y, with g and reach as below.
        """
        p, q = self.p, self.q
        most = F.col("n") - F.ceil(F.lit(p) * F.col("n") / q) if root else F.floor(F.lit(q - p) * F.col("n") / p)
        rows = family.select("f", "x", "n", "d", F.explode("items").alias("e"))
        count = rows.groupBy("f", "e").agg(F.count("*").alias("c")).where("c > 1")
        held = rows.join(count, ["f", "e"]).groupBy("f", "x", "n", "d").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("es"))
        held = held.withColumn("own", F.col("d") - F.size("es")).withColumn("more", (most - F.col("own") + 1).cast("int")).where("more > 0")
        rows = held.select("f", "x", "n", "d", "own", F.posexplode(F.slice("es", F.lit(1), F.col("more"))).alias("at", "y"))
        sizes = (q - p) * F.col("n")
        rows = rows.select("f", F.col("y.e").alias("e"), "x", "n", ((q + p) * F.col("d") - sizes).alias("g"), ((q + p) * (F.col("d") - 2 * (F.col("own") + F.col("at"))) + sizes).alias("reach"))
        each = rows.groupBy("f", "e").agg(F.count("*").alias("c"), F.min("g").alias("lo"), F.max("reach").alias("hi")).where("c > 1")
        return rows.join(each, ["f", "e"]).where("g <= hi AND reach >= lo").select("f", "e", "x", "n", "g", "reach")

    def _labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("label", F.col("x"))
        return rows.join(self.labels.select(F.col("node").alias("x"), F.col("label").alias("_l")), "x", "left").withColumn("label", F.coalesce("_l", "x")).drop("_l")

    def _fits(self, a: str, b: str):
        """Sizes and places of the pair of the columns with these prefixes allow a link."""
        n, m = F.col(a + "n"), F.col(b + "n")
        sizes = self.q * F.least(n, m) >= self.p * F.greatest(n, m)
        return sizes & (F.col(a + "g") <= F.col(b + "reach")) & (F.col(b + "g") <= F.col(a + "reach"))

    def centres(self, rows: DataFrame, level: int, number: int) -> DataFrame:
        """f, e and centres (a, an, ag, areach, alabel) of each region with several components, so many for each.

        The first is the member with the least differences of its own, which is the nearest to what a group of copies
        was made from; the others are drawn by hash.
        """
        of = F.struct(*[F.col(c).alias("a" + ("" if c == "x" else c)) for c in ("x", "n", "g", "reach", "label")]).alias("c")
        before = 2 * (self.q - self.p) * F.col("n") + F.col("g") - F.col("reach")  # grows with its place
        by = [before, *[F.xxhash64("x", F.lit(k + number * level)) for k in range(1, number)]]
        least = F.array(*[F.min(F.struct(F.floor(F.log2(F.col("n").cast("double"))).alias("size"), x.alias("h"), of))["c"] for x in by])
        each = rows.groupBy("f", "e").agg(least.alias("cs"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        return each.where("lo < hi").select("f", "e", F.inline("cs")).distinct()

    def star(self, rows: DataFrame, level: int) -> DataFrame:
        """Pairs (centre, member) of different components that may link."""
        met = rows.join(self.centres(rows, level, CENTRES), ["f", "e"]).where("label <> alabel").where(self._fits("", "a"))
        return met.select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b")).distinct()

    def unsettled(self, rows: DataFrame) -> DataFrame:
        """The rows of regions with several components whose places leave them a partner in another one.

        For members of a region's largest component the others are known by their extremes, for the others all are.
        """
        own = rows.groupBy("f", "e", "label").agg(F.count("*").alias("c"), F.min("g").alias("lo"), F.max("reach").alias("hi"))
        all_ = own.groupBy("f", "e").agg(F.max(F.struct("c", "label"))["label"].alias("major"), F.min("lo").alias("alo"), F.max("hi").alias("ahi"), F.count("*").alias("k")).where("k > 1")
        rest = own.join(all_.select("f", "e", "major"), ["f", "e"]).where("label <> major").groupBy("f", "e").agg(F.min("lo").alias("olo"), F.max("hi").alias("ohi"))
        met = rows.join(all_.join(rest, ["f", "e"]), ["f", "e"])
        return met.where("CASE WHEN label = major THEN g <= ohi AND reach >= olo ELSE g <= ahi AND reach >= alo END").select("f", "e", "x", "n", "g", "reach", "label")

    def pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of different components that may link, of regions that are compared as they are."""
        a, b = (rows.select("f", "e", *[F.col(x).alias(side + x) for x in ("x", "n", "g", "reach", "label")]) for side in "ab")
        met = a.join(b, ["f", "e"]).where("alabel <> blabel AND ax < bx").where(self._fits("a", "b"))
        return met.select(F.col("ax").alias("a"), F.col("bx").alias("b")).distinct()

    def run(self) -> DataFrame:
        """doc, n_shingles and component (the smallest doc reachable) of every row."""
        members = saved(self.members(), "jaccard-members")
        named = members.where("set IS NOT NULL AND doc IS NOT NULL").groupBy(F.col("set").alias("k")).agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("m").alias("m"))
        counted = saved(self.counted(members.agg(F.sum("n")).first()[0] or 0), "jaccard-counted")
        unshared = F.col("m") - F.coalesce("c", F.lit(0))
        live = named.join(counted, "k", "left").where(unshared <= F.col("n") - F.ceil(F.lit(self.p) * F.col("n") / self.q))
        live = saved(live.select("doc", "k"), "jaccard-live")
        self.sets = saved(self.sets_of(live), "jaccard-sets")
        dropped(counted, live)
        self.labels = None
        family = self.sets.select(F.lit(0).cast("long").alias("f"), F.col("k").alias("x"), "n", F.col("n").alias("d"), "items")
        for level in range(self.levels):
            rows = saved(self.regions(family, level == 0), "jaccard-regions")
            if level:
                dropped(family)
            family = self._joined(rows, level)
            dropped(rows)
            if family is None:
                break
        dropped(self.sets)
        return self._named(members)

    def _joined(self, rows: DataFrame, level: int) -> DataFrame | None:
        """Joins the regions; returns the families of those that were too large, if any."""
        self._compared(self.star(self._labelled(rows), level))
        rows = saved(self.unsettled(self._labelled(rows)), "jaccard-open")
        if not rows_of(rows):
            dropped(rows)
            return None
        each = rows.groupBy("f", "e", "label").agg(F.count("*").alias("c")).groupBy("f", "e").agg((F.sum("c") - F.max("c")).alias("minority"))
        rows, first = saved(rows.join(each, ["f", "e"]).where("minority > 0"), "jaccard-open"), rows
        dropped(first)
        large = F.col("minority") > self.cap if level < self.levels - 1 else F.lit(False)
        family = None
        if rows_of(rows) and not rows.where(large).isEmpty():
            wide = rows.where(large)
            centre = self.centres(wide, self.levels, 1).select("f", "e", "a")
            star = saved(wide.join(centre, ["f", "e"]).where("x <> a").select("a", F.col("x").alias("b")).distinct(), "jaccard-families")
            family = saved(self.differences(star), "jaccard-differences")
            dropped(star)
            self._link(self.close(family))
        if rows_of(rows):
            self._compared(self.pairs(self._labelled(rows.drop("label")).where(~large)))
        dropped(rows)
        return family

    def _compared(self, pairs: DataFrame) -> bool:
        pairs = saved(pairs, "jaccard-pairs")
        found = rows_of(pairs) > 0 and self._link(self.linked(pairs))
        dropped(pairs)
        return found

    def _link(self, found: DataFrame) -> bool:
        """Takes links (a, b) into the labels; whether there were any between two components."""
        if self.labels is not None:
            for side in "ab":
                to = self.labels.select(F.col("node").alias(side), F.col("label").alias("_l"))
                found = found.join(to, side, "left").withColumn(side, F.coalesce("_l", side)).drop("_l")
        links = saved(found.where("a <> b").distinct(), "jaccard-links")
        if not rows_of(links):
            dropped(links)
            return False
        moved, old = components(links), self.labels
        if old is None:
            self.labels = moved
            dropped(links)
            return True
        to = moved.select(F.col("node").alias("label"), F.col("label").alias("_l"))
        again = old.join(to, "label", "left").select("node", F.coalesce("_l", "label").alias("label"))
        self.labels = saved(again.union(moved.join(old, "node", "left_anti").select("node", "label")), "jaccard-labels")
        dropped(moved, old, links)
        return True

    def _named(self, members: DataFrame) -> DataFrame:
        named = members.withColumn("label", F.col("set"))
        if self.labels is not None:
            named = members.join(self.labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
        named = saved(named.select("doc", "n", F.expr("CASE WHEN doc IS NOT NULL THEN label END").alias("label")), "jaccard-named")
        dropped(members)
        least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc").alias("component"))
        out = named.join(least, "label", "left")
        return out.select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def _shared(s: np.ndarray, share: int) -> np.ndarray:
    """The hashes of a sorted set that are in the share."""
    return s[: np.searchsorted(s, np.uint64(1 << (64 - share)))] if share else s


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """Items that two sorted sets have in common."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s):
        return 0
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


def _lists(items: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, items)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *items])))


def _part(bucket: int, kind: int, data: bytes, names: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary()), pa.array([names], pa.binary())], names=["bucket", "kind", "data", "names"])


def _chunks(batches: Iterable[pa.RecordBatch], most: int, width: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Distinct sets and their fingerprints, of as much text as a chunk holds."""
    sets: dict[int, np.ndarray] = {}
    size = 0
    for b in batches:
        for t in b.column(0):
            text = t.as_py()
            s = shingle_set(text, width)
            if len(s):
                sets.setdefault(fingerprint(s), s)
            size += len(text)
            if size >= most:
                yield list(sets.values()), list(sets)
                sets, size = {}, 0
    yield list(sets.values()), list(sets)


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    return JaccardJoin(docs, **options).run().select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each component: that of its smallest doc_id; rows without shingles all stay.

    Rows with a null doc_id stay as well. Rows that share a doc_id stay or go together: they go if each of them is
    in the component of a smaller one.
    """
    each = join(docs, **options).groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"))
    gone = saved(each.where("gone").select("doc_id"), "jaccard-gone")
    side = F.broadcast(gone) if rows_of(gone) <= BROADCAST_ROWS else gone
    return docs.join(side, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
