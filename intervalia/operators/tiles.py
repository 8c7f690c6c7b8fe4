"""All-pairs work in tiles: every item is sent to the tiles of its block, and a task holds two blocks at a time.

The number of blocks follows from the number of items, so a tile has about 2 * SIZE items whatever the table's size;
no join is made, and pairs are formed in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.sources.fixtures import apart

SIZE = 256
#: Items of a block, at most, where a tile gives less than a row for each pair, and rows that it has distances of at a time.
COARSE, STRIP = 16384, 256
#: Pairs whose rows are laid side by side at a time.
AT_ONCE = 8192


def tiled(items: DataFrame, key: str, f: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, size: int | None = None, within: str | None = None, piece: int | None = SIZE) -> DataFrame:
    """f(a, b, same) over all pairs of blocks: two frames of items, or the same one twice.

    Every item is sent once for each block, so blocks grow with the table, to COARSE items, unless a size is given. A task
    gives f pieces of its blocks, one after the other, or the whole of them if piece is None.

    within names a column: blocks are then of items that are alike in it, and only those meet. Rows with a null key, or null
    there, are left out. An empty table gives no rows.
    """
    items = items.where(F.col(key).isNotNull())
    if within is None:
        many = items.count()
        size = size or min(COARSE, max(piece or SIZE, many // (16 if piece else 8)))
        items = items.withColumn("_n", F.lit(max(1, -(-many // size))))
    else:
        share = F.lit(size) if size else F.least(F.lit(COARSE), F.greatest(F.lit(piece or SIZE), F.ceil(F.count("*") / 8)))
        counts = items.groupBy(within).agg(F.ceil(F.count("*") / share).alias("_n"))
        items = items.join(counts, within)
    block = F.pmod(F.xxhash64(key), F.col("_n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")))
    dealt = items.withColumn("_b", block).withColumn("_o", other)
    dealt = dealt.withColumns({"_x": F.least("_b", "_o"), "_y": F.greatest("_b", "_o")}).drop("_o", "_n")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(batches))
        x, y = int(group["_x"].iloc[0]), int(group["_y"].iloc[0])
        own = group.drop(columns=["_x", "_y"]).sort_values(key, kind="stable")
        a, b = (own[own["_b"] == k].drop(columns="_b") for k in (x, y))
        step = piece or max(len(a), len(b))
        for p in range(0, len(a), step):
            for q in range(p if x == y else 0, len(b), step):
                yield f(a.iloc[p : p + step], b.iloc[q : q + step], x == y and p == q)

    by = ["_x", "_y", *([within] if within else [])]
    return apart(dealt, *by).groupBy(*by).applyInPandas(each, schema)


def pairs(vectors: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], symmetric: bool = True, size: int = SIZE, within: bool = False) -> DataFrame:
    """i < j, labels li and lj, and d = measure(rows, rows) of all pairs of vectors (vec_id, v, label), or of those within a label.

    A symmetric measure gives the distances of all rows of one to all rows of the other. One that is not gets
    a row of i and one of j for each pair, and gives their distances.
    """

    def each(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "j": [], "li": [], "lj": [], "d": []}).astype({"i": "int64", "j": "int64", "li": "int64", "lj": "int64"})
        i, j = np.triu_indices(len(a), 1) if same else np.divmod(np.arange(len(a) * len(b)), len(b))
        ka, kb, la, lb = a["vec_id"].to_numpy(), b["vec_id"].to_numpy(), a["label"].to_numpy(), b["label"].to_numpy()
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        turn = ka[i] > kb[j]
        if symmetric:
            d = measure(x, y)[i, j]
        else:
            parts = [slice(k, k + AT_ONCE) for k in range(0, len(i), AT_ONCE)]
            d = np.concatenate([np.zeros(0), *[measure(np.where(turn[p, None], y[j[p]], x[i[p]]), np.where(turn[p, None], x[i[p]], y[j[p]])) for p in parts]])
        return pd.DataFrame({"i": np.where(turn, kb[j], ka[i]), "j": np.where(turn, ka[i], kb[j]), "li": np.where(turn, lb[j], la[i]), "lj": np.where(turn, la[i], lb[j]), "d": d})

    return tiled(vectors.select("vec_id", "v", "label"), "vec_id", each, "i long, j long, li int, lj int, d double", None, "label" if within else None, size)


def sums(vectors: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, within: bool = False) -> DataFrame:
    """i, li, lj, n, s and q: number, sum and sum of squares of the distances of each vector to the others of each label, or of its own.

    Tiles add them up, so pairs are not given out: a row for each vector, label and block. The measure is symmetric, as in pairs.
    """
    d_of = measure or euclidean_fast

    def one(x: pd.DataFrame, y: pd.DataFrame, s: np.ndarray, q: np.ndarray, first: np.ndarray, own: np.ndarray | None) -> pd.DataFrame:
        label = y["label"].to_numpy(float)
        many = np.diff(np.append(first, len(y)))
        n = np.tile(many, (len(x), 1))
        if own is not None:
            n[np.arange(len(x)), own] -= 1
        out = pd.DataFrame({"i": np.repeat(x["vec_id"].to_numpy(), len(first)), "li": np.repeat(x["label"].to_numpy(float), len(first)), "lj": np.tile(label[first], len(x)), "n": n.reshape(-1), "s": s.reshape(-1), "q": q.reshape(-1)})
        return out[out["n"] > 0]

    def each(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "li": [], "lj": [], "n": [], "s": [], "q": []}).astype({"i": "int64", "n": "int64"})
        a, b = (t.sort_values(["label", "vec_id"], kind="stable") for t in (a, b))
        (x, fa, ga), (y, fb, _) = ((np.stack(t["v"].to_numpy()), np.unique(k, return_index=True)[1], np.unique(k, return_inverse=True)[1]) for t in (a, b) for k in [t["label"].fillna(np.inf).to_numpy(float)])
        mine, theirs = np.zeros((2, len(x), len(fb))), np.zeros((2, len(fa), len(y)))
        for k in range(0, len(x), STRIP):
            d = d_of(x[k : k + STRIP], y)
            labels, first = np.unique(ga[k : k + STRIP], return_index=True)
            for power, t in enumerate((d, d * d)):
                mine[power, k : k + STRIP] = np.add.reduceat(t, fb, axis=1)
                if not same:
                    theirs[power, labels] += np.add.reduceat(t, first, axis=0)
        if same:
            return one(a, a, *mine, fa, ga)
        return pd.concat([one(a, b, *mine, fb, None), one(b, a, theirs[0].T, theirs[1].T, fa, None)])

    rows = vectors.where("v IS NOT NULL").select("vec_id", "v", "label")
    parts = tiled(rows, "vec_id", each, "i long, li double, lj double, n long, s double, q double", None, "label" if within else None, None)
    by = [F.col("i"), F.col("li").cast("int").alias("li"), F.col("lj").cast("int").alias("lj")]
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def correlation_distances(vectors: DataFrame, side: int = 1024) -> DataFrame:
    """i < j and d: one less the correlation of the distances of i to all vectors with those of j, null where they are constant.

    A task has two blocks of rows and one of columns, and forms their distances from the vectors. Up to COARSE vectors
    are one block of columns; the products of more are added up.
    """
    total = sums(vectors).groupBy(F.col("i").alias("vec_id")).agg((F.sum("n") + 1).alias("_m"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    mean = F.col("_s") / F.col("_m")
    rows = vectors.where("v IS NOT NULL").select("vec_id", "v").join(total.select("vec_id", mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") - F.col("_s") * mean, F.lit(0.0))).alias("norm")).hint("merge"), "vec_id")
    many = rows.count()
    n, m = max(1, -(-many // min(side, max(SIZE, many // 6)))), max(1, -(-many // COARSE))
    block = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = rows.withColumn("_b", block(n)).withColumn("_o", every(n)).withColumn("_z", every(m))
    own = own.select("vec_id", "v", "mean", "norm", "_b", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"), "_z")
    across = rows.withColumn("_z", block(m)).withColumn("_x", every(n)).withColumn("_y", F.explode(F.sequence("_x", F.lit(n - 1)))).withColumn("_b", F.lit(-1))

    def each(group: pd.DataFrame) -> pd.DataFrame:
        x, y = int(group["_x"].iloc[0]), int(group["_y"].iloc[0])
        a, b, c = (group[group["_b"] == k].sort_values("vec_id") for k in (x, y, -1))
        if not len(a) or not len(b) or not len(c):
            return pd.DataFrame({"i": [], "j": [], "r": []}).astype({"i": "int64", "j": "int64"})
        columns = np.stack(c["v"].to_numpy())
        r = np.zeros((len(a), len(b)))
        with np.errstate(invalid="ignore", divide="ignore"):
            for k in range(0, len(columns), SIZE):
                z = [(euclidean_fast(np.stack(t["v"].to_numpy()), columns[k : k + SIZE]) - t["mean"].to_numpy()[:, None]) / t["norm"].to_numpy()[:, None] for t in ((a,) if x == y else (a, b))]
                r += z[0] @ z[-1].T
        i, j = np.triu_indices(len(a), 1) if x == y else np.divmod(np.arange(r.size), len(b))
        p, q = a["vec_id"].to_numpy()[i], b["vec_id"].to_numpy()[j]
        return pd.DataFrame({"i": np.minimum(p, q), "j": np.maximum(p, q), "r": r[i, j]})

    dealt = own.unionByName(across.select(own.columns))
    parts = apart(dealt, "_x", "_y", "_z").groupBy("_x", "_y", "_z").applyInPandas(each, "i long, j long, r double")
    if m > 1:
        parts = parts.groupBy("i", "j").agg(F.sum("r").alias("r"))
    return parts.select("i", "j", (1 - F.col("r")).alias("d"))


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a and b, from differences, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    for k in range(0, len(a), 16):
        gap = a[k : k + 16, None, :] - b[None, :, :]
        out[k : k + 16] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def euclidean_fast(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same by products, with the differences themselves of rows that are close for their size."""
    scale = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)
    d = scale - 2 * (a @ b.T)
    i, j = np.nonzero(~(d > 1e-4 * scale))
    for k in range(0, len(i), AT_ONCE):
        gap = a[i[k : k + AT_ONCE]] - b[j[k : k + AT_ONCE]]
        d[i[k : k + AT_ONCE], j[k : k + AT_ONCE]] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(d, out=d)
