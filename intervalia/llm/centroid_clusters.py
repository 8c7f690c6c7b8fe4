"""Centroid clustering by filtering balls of metric trees.

Every task puts the vectors of its partition into metric trees of at most BLOCK vectors. A ball of a tree has a centre,
a radius, and the count and integer sums of its members. A round sends the centroids down every tree: by the triangle
inequality a centroid farther from the centre than the nearest one by more than two radii is nearest to no member, so it
leaves the candidates below; a ball with one candidate left is counted whole from its sums, and what reaches a leaf with
more is decided by exact integer distances, vector by vector. Trees are built once and written to the shared folder; a
round returns sums for each centroid, so the driver holds the centroids alone, whatever the number of vectors.

A vector is kept if it has exactly the stated number of components, none null, NaN or infinite; a component x becomes
floor(scale * x). Components beyond LARGEST after that are left out like infinite ones, as their distances would not fit
a long. Seeds are the vectors of smallest sha256 of "<seed>:<vec_id>"; equal hashes go by vec_id, then by the vector. A null
vec_id has no hash and comes last as a seed, but is clustered. Repeated rows are clustered each. With fewer vectors than
centroids every vector is a seed. Equal distances go to the smaller number. An empty table gives no rows. inertia and
cluster_inertia are null where the sum does not fit a long. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import saved

#: Vectors of one tree, and of a leaf before it is split.
BLOCK, LEAF = 4096, 32
#: Largest size of an integer component: 64 squared differences of twice that fit a long.
LARGEST = 2**27
#: Squared norms are summed in two parts of this many bits, so that sums over a block and a task fit a long.
HALF = 30
TREES = "ids array<long>, width int, data binary, radii binary, sums binary"


def exact_distances(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exact: in doubles where all sums stay below 2**53, else in integers."""
    most = max(np.abs(x).max(initial=0), np.abs(z).max(initial=0))
    if 4 * x.shape[1] * float(most) ** 2 < 2**53:
        x, z = x.astype(float), z.astype(float)
    return ((x * x).sum(1)[:, None] - 2 * (x @ z.T) + (z * z).sum(1)).astype(np.int64)


def sums_of(x: np.ndarray) -> np.ndarray:
    """Component sums, both parts of the sum of squared norms, and the count."""
    squares = (x * x).sum(1)
    return np.concatenate([x.sum(0), [(squares >> HALF).sum(), (squares & (1 << HALF) - 1).sum(), len(x)]]).astype(np.int64)


def splits(n: int, leaf: int) -> list[list[tuple[int, int]]]:
    """Ranges of the nodes of a balanced tree over n vectors, level by level; every node of a level is halved or none."""
    levels = [[(0, n)]]
    while levels[-1][0][1] - levels[-1][0][0] > leaf:
        levels.append([part for a, b in levels[-1] for part in ((a, (a + b) // 2), ((a + b) // 2, b))])
    return levels


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the vectors in the tree, radii and sums of its nodes by level. A node is cut at the median of its widest axis."""
    order = np.arange(len(x))
    radii, sums = [], []
    levels = splits(len(x), leaf)
    for depth, level in enumerate(levels):
        for a, b in level:
            members = x[order[a:b]]
            s = sums_of(members)
            gaps = members - s[: x.shape[1]] / max(b - a, 1)
            radii.append(np.sqrt((gaps * gaps).sum(1).max(initial=0.0)))
            sums.append(s)
            if depth + 1 < len(levels):
                axis = int((gaps * gaps).sum(0).argmax())
                order[a:b] = order[a:b][np.argpartition(members[:, axis], (a + b) // 2 - a)]
    return order, np.array(radii), np.array(sums)


def descend(n: int, radii: np.ndarray, sums: np.ndarray, centroids: np.ndarray, leaf: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Node, its range, and the centroids that may be nearest to a member: one for a whole ball, more for a leaf."""
    levels = splits(n, leaf)
    dim = centroids.shape[1]
    at, may = np.array([0]), np.ones((1, len(centroids)), bool)
    first = 0
    for depth, level in enumerate(levels):
        s = sums[first + at]
        centres = s[:, :dim] / s[:, -1:]
        far = np.sqrt(((centres[:, None, :] - centroids[None]) ** 2).sum(2))
        far[~may] = np.inf
        near, r = far.min(1, keepdims=True), radii[first + at][:, None]
        # rounding of the roots is far below the allowance
        may = far <= near + 2 * r + 1e-9 * (1 + near + r)
        whole = may.sum(1) == 1
        done = np.ones(len(at), bool) if depth + 1 == len(levels) else whole
        for k in np.flatnonzero(done):
            yield first + int(at[k]), *level[at[k]], np.flatnonzero(may[k])
        rest = at[~done]
        may = np.repeat(may[~done], 2, axis=0)
        at = np.stack([2 * rest, 2 * rest + 1], 1).ravel()
        first += len(level)
        if not len(at):
            return


def trees(vectors: DataFrame, size: int, scale: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Trees of the kept vectors of each partition: vec_ids and vectors in the order of the leaves, radii and sums of nodes."""

    def planted(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order, radii, sums = build(x, leaf)
        width = next(w for w in (1, 2, 4) if np.abs(x).max(initial=0) < 1 << 8 * w - 1)
        columns = [pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array([width], pa.int32())]
        columns += [pa.array([a.tobytes()], pa.binary()) for a in (x[order].astype(f"<i{width}"), radii.astype("<f8"), sums.astype("<i8"))]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "width", "data", "radii", "sums"])

    def plant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, n = [], [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                part = batch.slice(begin, block)
                held.append(part.column(0))
                parts.append(integers(part.column(1), size, scale))
                n += part.num_rows
                if n >= block:
                    ids, x = pa.concat_arrays(held), np.concatenate(parts)
                    yield planted(ids[:block], x[:block])
                    held, parts, n = [ids[block:]], [x[block:]], n - block
        if n:
            yield planted(pa.concat_arrays(held), np.concatenate(parts))

    return saved(whole(vectors, size, scale).mapInArrow(plant, TREES), "ball-trees")


def whole(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and embedding of the rows with a vector of so many components, all finite and small enough."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # NaN is above every number in Spark, so it fails the upper bound
    fits = F.forall("embedding", lambda x: F.coalesce((scale * x >= -LARGEST) & (scale * x < LARGEST + 1), F.lit(False)))
    return rows.where((F.size("embedding") == size) & fits)


def integers(embedding: pa.Array, size: int, scale: int) -> np.ndarray:
    return np.floor(scale * np.asarray(embedding.flatten(), float)).astype(np.int64).reshape(-1, size)


def seeds(vectors: DataFrame, size: int, scale: int, k: int, seed: int) -> np.ndarray:
    """The k kept vectors of least hash, by a top-k of Spark."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = whole(vectors, size, scale).select("vec_id", "embedding", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "vec_id", "embedding").limit(k)
    return np.floor(scale * np.array([r.embedding for r in best.collect()], float).reshape(-1, size)).astype(np.int64)


def unpacked(row: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["data"], f"<i{row['width']}").reshape(-1, size).astype(np.int64)
    return x, np.frombuffer(row["radii"], "<f8"), np.frombuffer(row["sums"], "<i8").reshape(-1, size + 3)


def totals(planted: DataFrame, centroids: np.ndarray, leaf: int) -> np.ndarray:
    """For each centroid the component sums, sum of squared norms and count of the vectors nearest to it, as Python integers."""
    k, size = centroids.shape

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, size + 3), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x, radii, sums = unpacked(row, size)
                for node, a, b, may in descend(len(x), radii, sums, centroids, leaf):
                    if len(may) == 1:
                        out[may[0]] += sums[node]
                    else:
                        nearest = may[exact_distances(x[a:b], centroids[may]).argmin(1)]
                        for c in np.unique(nearest):
                            out[c] += sums_of(x[a:b][nearest == c])
        filled = np.flatnonzero(out[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(filled, size + 3), pa.int32()), pa.array(np.tile(np.arange(size + 3), len(filled)), pa.int32()), pa.array(out[filled].ravel())], names=["c", "j", "s"])

    parts = planted.select("width", "data", "radii", "sums").mapInArrow(gather, "c int, j int, s long")
    out = np.zeros((k, size + 3), object)
    # as many rows as centroids and components
    for c, j, s in parts.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():
        out[c, j] = int(s)
    return np.column_stack([out[:, :size], (out[:, size] << HALF) + out[:, size + 1], out[:, size + 2]]) if k else out[:, 1:]


def fitting(n: int) -> int | None:
    return n if n < 2**63 else None


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector of vectors (vec_id, embedding)."""
    planted = trees(vectors, size, scale, block, leaf)
    centroids = seeds(vectors, size, scale, k, seed)
    for _ in range(rounds):
        centroids = np.array([[int(s) // int(t[-1]) for s in t[:size]] if t[-1] else c for c, t in zip(centroids, totals(planted, centroids, leaf))], np.int64).reshape(-1, size)
    # the sum of |x - z|**2 is that of |x|**2, less twice z with the sum of x, and the count by |z|**2
    each = [int(t[-2]) - 2 * sum(int(a) * int(b) for a, b in zip(t[:size], c)) + int(t[-1]) * sum(int(a) ** 2 for a in c) for c, t in zip(centroids, totals(planted, centroids, leaf))]
    inertias, inertia = [fitting(x) for x in each], fitting(sum(each))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, radii, sums = unpacked(row, size)
                nearest, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
                for _, a, b, may in descend(len(x), radii, sums, centroids, leaf):
                    far = exact_distances(x[a:b], centroids[may])
                    best = far.argmin(1)
                    nearest[a:b], distance[a:b] = may[best], far[np.arange(b - a), best]
                columns = [pa.array(row["ids"], pa.int64()), pa.array(nearest), pa.array(distance), pa.array([inertias[c] for c in nearest], pa.int64()), pa.array([inertia] * len(x), pa.int64()), pa.array([digests[c] for c in nearest])]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return planted.mapInArrow(assign, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same by plain distances of all vectors to all centroids, for vectors whose components are within LARGEST."""
    gap = "list_sum(list_transform(list_zip(kept.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT kept.r, kept.vec_id, kept.v, z.c, CAST({gap} AS BIGINT) AS d FROM kept CROSS JOIN z{n} AS z QUALIFY row_number() OVER (PARTITION BY kept.r ORDER BY d, z.c) = 1)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({size})) AS j FROM a{n}) GROUP BY c, j))")
            steps.append(f"z{n + 1} AS MATERIALIZED (SELECT z.c, coalesce(m.v, z.v) AS v FROM z{n} AS z LEFT JOIN (SELECT c, list(x ORDER BY j) AS v FROM m{n} GROUP BY c) AS m USING (c))")
    return f"""
WITH whole AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {size}),
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: TRY_CAST(floor({scale} * x) AS BIGINT)) AS v
  FROM whole WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
z0 AS MATERIALIZED (SELECT n - 1 AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, vec_id, v) AS n FROM kept) WHERE n <= {k}),
{", ".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN z{rounds} AS z USING (c)"""
