"""Which type of a few templates each item is most like: warped and straight distances, their ranks among all, and how rows of ranks correlate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervalia.operators import measures, tiles, warp
from intervalia.sources.shared import written

#: Templates at most: every task holds them, and their own rows of ranks.
MOST = 1000


def templates(vectors: DataFrame, each: int) -> list[tuple[int, int, np.ndarray]]:
    """vec_id, label and v of the `each` vectors of least id of every label."""
    x = vectors.where("v IS NOT NULL AND label IS NOT NULL")
    # Spark keeps the first ranks of a label in each task before it sends them
    least = x.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("n") <= each)
    found = least.select("vec_id", "label", "v").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} templates")
    return sorted((int(r["vec_id"]), int(r["label"]), np.array(r["v"], float)) for r in found)


def distances(vectors: DataFrame, chosen: list[tuple[int, int, np.ndarray]], features: int) -> DataFrame:
    """i, j (number of the template), near and far: straight and warped distance of every vector to every template."""
    stack = np.stack([v for _, _, v in chosen])

    def each(batches):
        for b in batches:
            for begin in range(0, len(b), 512):
                own = b.iloc[begin : begin + 512]
                x = np.stack(own["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"i": np.repeat(own["vec_id"].to_numpy(), len(chosen)), "j": np.tile(np.arange(len(chosen)), len(own)), "near": tiles.euclidean(x, stack).reshape(-1), "far": warp.all_pairs(10 * x, 10 * stack, features).reshape(-1)})

    return vectors.where("v IS NOT NULL").select("vec_id", "v").mapInPandas(each, "i long, j long, near double, far double")


def scores(vectors: DataFrame, chosen: list[tuple[int, int, np.ndarray]], features: int = 4) -> DataFrame:
    """i, type and score of every vector and type of template: the mean of the correlation distances of its row of fused ranks to those of the templates.

    A rank is the share of all distances of one kind to templates that are as small; fused are the ranks of both kinds, by the root of their product.
    """
    d = written(distances(vectors, chosen, features), "template-distances")
    rank = lambda c, name: measures.empirical(d.select("i", "j", F.round(c, 9).alias("d"))).select("i", "j", F.col("p").alias(name))
    fused = rank("near", "p").join(rank("far", "q"), ["i", "j"]).select("i", "j", F.sqrt(F.col("p") * F.col("q")).alias("f"))
    # as many ranks in a row as templates
    rows = fused.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "f"))), lambda s: s["f"]).alias("row"))
    rows = written(rows, "template-rows")
    own = {r["i"]: r["row"] for r in rows.where(F.col("i").isin([k for k, _, _ in chosen])).collect()}
    kinds = np.array([label for _, label, _ in chosen])
    types = np.unique(kinds)
    centred = np.array([np.array(own[k]) - np.mean(own[k]) for k, _, _ in chosen])
    size = np.sqrt((centred**2).sum(1))

    def score(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["row"].to_numpy()).astype(float)
                x = x - x.mean(1, keepdims=True)
                with np.errstate(invalid="ignore", divide="ignore"):
                    apart = 1 - (x @ centred.T) / (np.sqrt((x * x).sum(1))[:, None] * size)
                means = np.stack([apart[:, kinds == t].mean(1) for t in types], 1)
                yield pd.DataFrame({"i": np.repeat(b["i"].to_numpy(), len(types)), "type": np.tile(types, len(b)), "score": means.reshape(-1)})

    return rows.mapInPandas(score, "i long, type long, score double")


def best(scored: DataFrame, key: str = "i") -> DataFrame:
    """key, type and score of the type of least mean score, the smaller type of equals."""
    means = scored.groupBy(key, "type").agg(F.avg("score").alias("score"))
    return means.groupBy(key).agg(F.min(F.struct(F.round("score", 9).alias("r"), "type", "score")).alias("m")).select(key, "m.type", "m.score")
