"""Signed ranks of differences by key, with ranks from counts per stretch of the axis, so that no key is ranked in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.operators.smoothing import ranked


def signed_rank(rows: DataFrame, stretch: float) -> DataFrame:
    """key, n, w (the sum of the ranks of positive differences) and z, the normal deviate of w with ties allowed for.

    rows has key, id and d. Differences of 0 and nulls are left out, equal sizes share the mean of their ranks. stretch is a length of the axis of
    sizes of which a key has few enough differences for a task.
    """
    x = rows.where("d IS NOT NULL AND NOT isnan(d) AND d <> 0").select(F.col("key").alias("series"), "id", F.abs("d").alias("x"), (F.col("d") > 0).cast("double").alias("y"))
    ties = ranked(x, stretch).groupBy("series", "x").agg(F.count("*").alias("t"), (F.avg("r") + 1).alias("rank"), F.sum("y").alias("up"))
    n = F.sum("t")
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")) / 48
    out = ties.groupBy(F.col("series").alias("key")).agg(n.alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), spread.alias("v"))
    return out.select("key", "n", "w", F.when(F.col("v") > 0, (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt("v")).alias("z"))
