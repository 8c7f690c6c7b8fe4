"""Searches of some vectors among all, without forming all pairs: nearest neighbours, and mean distances to types of templates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervalia.operators import tiles

#: Queries, and vectors, of a task, at least and at most: blocks grow with the table, so that not many copies of it are sent.
ASKED, HELD, BLOCK = 1024, 4096, 32768
#: Queries whose distances a task has at a time.
STRIP = 128


def by_blocks(vectors: DataFrame, queries: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, key: str = "vec_id") -> DataFrame:
    """f(asks, holds) over all pairs of a block of queries and a block of vectors, both (vec_id, v, label); null vectors are left out.

    Vectors that are alike in the key are in one block.

    Vectors are sent once for each block of queries, and queries once for each block of vectors; f should give less than a row for each pair.
    """
    typed = lambda x: x.where("v IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("int").alias("label"))
    x, q = typed(vectors), typed(queries)
    parts = lambda rows, least, share: max(1, -(-rows // min(BLOCK, max(least, rows // share))))
    m, n = parts(q.count(), ASKED, 8), parts(x.count(), HELD, 6)
    block = lambda parts, key="vec_id": F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    ask = q.withColumn("a", block(m)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("asks", F.lit(True))
    hold = x.withColumn("b", block(n, key)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("asks", F.lit(False))

    def each(own):
        a, b = own[own["asks"]].sort_values("vec_id"), own[~own["asks"]].sort_values("vec_id")
        return f(a, b)

    return ask.unionByName(hold).groupBy("a", "b").applyInPandas(each, schema)


def rows_of(x: pd.DataFrame) -> np.ndarray:
    return np.stack(x["v"].to_numpy()) if len(x) else np.zeros((0, 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """i, j, its label lj, d and place of the k vectors (vec_id, v, label) nearest to each query, itself left out; distances equal to six places by vec_id.

    Each task keeps the k best of its block for every query, so what is shuffled after it is k rows for each query and block.
    """

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            asked, ids, labels = a["vec_id"].to_numpy(), b["vec_id"].to_numpy(), b["label"].to_numpy(float)
            x, y = rows_of(a), rows_of(b)
            for begin in range(0, len(x), STRIP):
                d = tiles.euclidean_fast(x[begin : begin + STRIP], y)
                # itself may be among the k + 1; those as near to six places are candidates too
                reach = np.partition(d, min(k, len(y) - 1), axis=1)[:, min(k, len(y) - 1)]
                i, j = np.nonzero(d <= reach[:, None] + 2e-6)
                other = asked[begin + i] != ids[j]
                i, j = i[other], j[other]
                gap = [np.sqrt(((x[begin + i[p]] - y[j[p]]) ** 2).sum(1)) for p in (slice(q, q + tiles.AT_ONCE) for q in range(0, len(i), tiles.AT_ONCE))]
                near = np.round(np.concatenate([np.zeros(0), *gap]), 6)
                order = np.lexsort((ids[j], near, i))
                i, j, near = i[order], j[order], near[order]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < k
                out.append(pd.DataFrame({"i": asked[begin + i[keep]], "j": ids[j[keep]], "lj": labels[j[keep]], "d": near[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "lj": [], "d": []}).astype({"i": "int64", "j": "int64"})

    found = by_blocks(vectors, queries, best, "i long, j long, lj double, d double").withColumn("lj", F.col("lj").cast("int"))
    # k rows of each block of vectors meet in the window of a query
    return found.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("place") <= k)


def mean_by_type(vectors: DataFrame, templates: DataFrame) -> DataFrame:
    """item, label, type and d: the mean distance of every vector to the templates of each label, itself left out."""

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"item": [], "label": [], "type": [], "s": [], "n": []}).astype({"item": "int64", "label": "int32", "type": "int32", "s": "float64", "n": "int64"})
        ids, labels, x, y = b["vec_id"].to_numpy(), b["label"].to_numpy(), rows_of(b), rows_of(a)
        types = np.unique(a["label"].to_numpy())
        kind = (a["label"].to_numpy()[:, None] == types).astype(float)
        out = []
        for begin in range(0, len(x), STRIP):
            part = slice(begin, begin + STRIP)
            other = ids[part, None] != a["vec_id"].to_numpy()
            d = tiles.euclidean_fast(x[part], y)
            out.append(pd.DataFrame({"item": np.repeat(ids[part], len(types)), "label": np.repeat(labels[part], len(types)), "type": np.tile(types, len(d)), "s": ((d * other) @ kind).reshape(-1), "n": (other @ kind).reshape(-1).astype(np.int64)}))
        return pd.concat(out)

    parts = by_blocks(vectors.where("label IS NOT NULL"), templates.where("label IS NOT NULL"), sums, "item long, label int, type int, s double, n long")
    return parts.groupBy("item", "label", "type").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").select("item", "label", "type", (F.col("s") / F.col("n")).alias("d"))


def median_by_label(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """i, lj and m: the median distance of every query to the vectors of each label, itself left out.

    A task has the vectors of whole labels, and distances of a few queries at a time.
    """

    def medians(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked, x = a["vec_id"].to_numpy(), rows_of(a)
        for label, own in b.groupby("label", dropna=False) if len(a) else ():
            ids, y = own["vec_id"].to_numpy(), rows_of(own)
            for begin in range(0, len(x), STRIP):
                d = tiles.euclidean_fast(x[begin : begin + STRIP], y)
                itself = asked[begin : begin + STRIP, None] == ids
                alone = itself.any(1)
                m = np.median(d, 1)
                if alone.any() and len(ids) > 1:
                    m[alone] = np.median(d[alone][~itself[alone]].reshape(alone.sum(), -1), 1)
                some = ~alone if len(ids) == 1 else np.ones(len(d), bool)
                out.append(pd.DataFrame({"i": asked[begin : begin + STRIP][some], "lj": float(label), "m": m[some]}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "lj": [], "m": []}).astype({"i": "int64"})

    found = by_blocks(vectors, queries, medians, "i long, lj double, m double", "label")
    return found.withColumn("lj", F.col("lj").cast("int"))
