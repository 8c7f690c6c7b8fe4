"""Queries of standard intervals (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervalia.operators import recognition
from intervalia.plans.registry import query
from intervalia.sources.fixtures import intervals

DAY_US, STEP, WIDTH = 86_400_000_000, 10.0, 30.0


def syllables(spark, d):
    """key (type), id, song (day), start and stop in minutes of the day."""
    x = intervals(spark, d)
    minute = lambda c: (F.col(c) - F.floor(F.col("start_us") / DAY_US) * DAY_US) / 60e6
    return x.select(F.col("type").alias("key"), "id", F.floor(F.col("start_us") / DAY_US).alias("song"), minute("start_us").alias("start"), minute("stop_us").alias("stop"))


def standards(spark, d):
    x = syllables(spark, d)
    return recognition.standard(x, x.groupBy("key").agg(F.count_distinct("song").alias("n")), STEP, WIDTH)


@query("k18_standard_intervals")
def k18(spark, d):
    """Where the events of each type usually begin and end in a day: peaks of the votes of at least 35 % of the days."""
    return standards(spark, d)


@query("k19_matched_intervals")
def k19(spark, d):
    """Events that match exactly one of these at both ends."""
    return recognition.matched(syllables(spark, d), standards(spark, d), WIDTH)
