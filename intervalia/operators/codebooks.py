"""K-means over whole tables with many restarts at once, and how well a codebook parts the vectors.

Restarts share the passes over the data: a task assigns its vectors to the centres of all restarts and sends sums, so
what reaches the driver is restarts times centres times dimensions. Seeds are vectors of least hash, different for each restart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def city(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows by the sum of differences."""
    return np.abs(x[:, None, :] - c[None]).sum(2)


def seeds(vectors: DataFrame, k: int, restarts: int, seed: int = 1) -> np.ndarray:
    """Centres (restarts, k, dimensions): for each restart the k vectors of least hash. With fewer vectors they repeat."""
    out = []
    for r in range(restarts):
        best = vectors.orderBy(F.xxhash64(F.lit(seed), F.lit(r), F.col("vec_id")), "vec_id").limit(k).select("v").collect()
        out.append([best[i % len(best)][0] for i in range(k)])
    return np.array(out, float)


def _sums(vectors: DataFrame, centres: np.ndarray, metric: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component sums, counts and summed distances of the vectors nearest to each centre of each restart."""
    restarts, k, size = centres.shape

    def part(batches):
        total = np.zeros((restarts, k, size + 2))
        for b in batches:
            x = np.stack(b["v"].to_numpy()).astype(float) if len(b) else np.zeros((0, size))
            for begin in range(0, len(x), 4096):
                own = x[begin : begin + 4096]
                for r in range(restarts):
                    d = metric(own, centres[r])
                    near = d.argmin(1)
                    np.add.at(total[r], near, np.column_stack([own, np.ones(len(own)), d[np.arange(len(own)), near]]))
        r, c = np.nonzero(total[:, :, size])
        yield pd.DataFrame({"r": r, "c": c, "s": pd.Series(list(total[r, c]), dtype=object)})

    parts = vectors.select("v").mapInPandas(part, "r int, c int, s array<double>").select("r", "c", F.posexplode("s").alias("j", "s"))
    out = np.zeros((restarts, k, size + 2))
    # restarts times centres times dimensions
    for r, c, j, s in parts.groupBy("r", "c", "j").agg(F.sum("s")).collect():
        out[r, c, j] = s
    return out[:, :, :size], out[:, :, size], out[:, :, size + 1]


def fitted(vectors: DataFrame, k: int, restarts: int, rounds: int = 20, metric: Callable = squared, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the best restart and the summed distances of all; empty clusters are dropped at the end.

    vectors (vec_id, v) may hold nulls, which are left out. No vectors give no centres.
    """
    x = vectors.where("v IS NOT NULL")
    if x.isEmpty():
        return np.zeros((0, 0)), np.zeros(0)
    centres = seeds(x, k, restarts, seed)
    for _ in range(rounds):
        sums, counts, _ = _sums(x, centres, metric)
        new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres)
        if np.abs(new - centres).max() < 1e-9:
            break
        centres = new
    _, counts, far = _sums(x, centres, metric)
    best = int(far.sum(1).argmin())
    return centres[best][counts[best] > 0], far.sum(1)


def assigned(vectors: DataFrame, centres: np.ndarray, metric: Callable = squared) -> DataFrame:
    """vec_id, cluster, d (to its centre), second (to the next centre) and ratio of both, 0 where the centre is met and null with one centre."""

    def part(batches):
        for b in batches:
            if len(b):
                d = metric(np.stack(b["v"].to_numpy()).astype(float), centres)
                near, order = d.argmin(1), np.sort(d, 1)
                second = order[:, 1] if d.shape[1] > 1 else np.full(len(b), np.nan)
                with np.errstate(invalid="ignore", divide="ignore"):
                    ratio = np.where(order[:, 0] == 0, 0.0, order[:, 0] / second)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": near.astype(np.int32), "d": order[:, 0], "second": second, "ratio": np.where(np.isnan(second), np.nan, ratio)})

    out = vectors.where("v IS NOT NULL").select("vec_id", "v")
    return (out if len(centres) else out.limit(0)).mapInPandas(part, "vec_id long, cluster int, d double, second double, ratio double")
