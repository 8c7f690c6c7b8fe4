"""Interval joins by key and time bucket.

Every interval is copied to the buckets that it touches; two intervals meet in the first bucket that both
touch, so no pair comes twice. The bucket turns a theta join into an equi-join on (key, bucket), which is
shuffled by hash and split by AQE where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, start: Column, stop: Column, width: int) -> DataFrame:
    lo, hi = F.floor(start / width), F.floor(stop / width)
    return df.withColumns({"_lo": lo, "_b": F.explode(F.sequence(lo, hi))})


def overlap_join(left: DataFrame, right: DataFrame, width: int, key: str = "series", closed: bool = False, how: str = "inner", margin: int = 0) -> DataFrame:
    """Pairs of overlapping intervals of one key; columns of left are prefixed with a_, of right with b_.

    closed: touching counts. margin: left is widened by so much for the search.
    """
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    a = _bucketed(a, F.col("a_start_us") - margin, F.col("a_stop_us") + margin, width).withColumnRenamed("_lo", "_la")
    b = _bucketed(b, F.col("b_start_us"), F.col("b_stop_us"), width).withColumnRenamed("_lo", "_lb")
    first = F.col("_b") == F.greatest("_la", "_lb")
    x, y = F.col("a_start_us") - margin, F.col("a_stop_us") + margin
    meets = (x <= F.col("b_stop_us")) & (F.col("b_start_us") <= y) if closed else (x < F.col("b_stop_us")) & (F.col("b_start_us") < y)
    return a.join(b.withColumnRenamed("_b", "_bb"), (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("_b") == F.col("_bb")) & first & meets, how).drop("_la", "_lb", "_b", "_bb")


def points_in(intervals: DataFrame, points: DataFrame, width: int, key: str = "series") -> DataFrame:
    """Points inside closed intervals: columns of intervals, and t_us."""
    a = _bucketed(intervals, F.col("start_us"), F.col("stop_us"), width).drop("_lo")
    p = points.select(F.col(key).alias("_k"), "t_us", F.floor(F.col("t_us") / width).alias("_pb"))
    return a.join(p, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_pb")) & F.col("t_us").between(F.col("start_us"), F.col("stop_us"))).drop("_b", "_k", "_pb")
