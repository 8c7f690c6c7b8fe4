"""Cross-correlograms of two point processes against trial shuffles.

A correlogram counts pairs of one series and trial by their lag. Events of one time are one row with a count, every
event of the second process goes to the buckets of the reach beside its own, and the pairs meet by series, trial
and bucket, so the join is by equal keys and bounded by the reach. A shuffle moves the trials of the second process of a series one place on in an order of
their hashes, so that no trial meets itself where there are two or more; what the shuffles have in common is what the trials share by their timing alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _timed(points: DataFrame, trial_us: int) -> DataFrame:
    """series, trial, t (from the start of the trial) and c, the events of that time."""
    trial = F.floor(F.col("t_us") / trial_us)
    x = points.dropna(subset=["series", "t_us"]).select("series", trial.alias("trial"), (F.col("t_us") - trial * trial_us).alias("t"))
    return x.groupBy("series", "trial", "t").agg(F.count("*").alias("c"))


def _histogram(a: DataFrame, b: DataFrame, reach_us: int, bin_us: int, *more: str | Column) -> DataFrame:
    """series, bin and pairs of a and b (series, trial, t, c), with the columns more of b."""
    near = F.explode(F.array(*[F.floor(F.col("t") / reach_us) + k for k in (-1, 0, 1)]))
    x = a.select("series", "trial", F.col("t").alias("ta"), F.col("c").alias("ca"), F.floor(F.col("t") / reach_us).alias("bucket"))
    y = b.select("series", "trial", F.col("t").alias("tb"), F.col("c").alias("cb"), near.alias("bucket"), *more)
    lag = F.col("tb") - F.col("ta")
    met = x.join(y, ["series", "trial", "bucket"]).where(F.abs(lag) <= reach_us)
    return met.groupBy("series", *more, F.floor(lag / bin_us).alias("bin")).agg(F.sum(F.col("ca") * F.col("cb")).alias("pairs"))


def raw(a: DataFrame, b: DataFrame, reach_us: int, bin_us: int, trial_us: int) -> DataFrame:
    """series, bin (of the lag of b behind a) and pairs of the events a and b (series, t_us), up to a lag of reach_us."""
    return _histogram(_timed(a, trial_us), _timed(b, trial_us), reach_us, bin_us)


def shuffled_trials(b: DataFrame, shuffles: int, seed: int = 1) -> DataFrame:
    """series, shuffle, trial and met: the trial of a that a trial of b meets in each shuffle. Series of one trial have none."""
    trials = b.select("series", "trial").distinct().withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
    # as many rows as trials of a series
    order = Window.partitionBy("series", "shuffle").orderBy(F.xxhash64(F.lit(seed), "series", "shuffle", "trial"), "trial")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = F.coalesce(F.lead("trial").over(order), F.first("trial").over(whole))
    return trials.withColumn("met", met).where("met <> trial")


def against_shuffles(a: DataFrame, b: DataFrame, reach_us: int, bin_us: int, trial_us: int, shuffles: int = 20, seed: int = 1) -> DataFrame:
    """series, bin, pairs, expected (mean of the shuffles), excess, sd and z; bins that neither the data nor a shuffle have are not returned.

    Series whose second process has one trial have no shuffles and are left out.
    """
    x, y = _timed(a, trial_us), _timed(b, trial_us)
    moved = y.join(shuffled_trials(y, shuffles, seed), ["series", "trial"]).select("series", F.col("met").alias("trial"), "t", "c", "shuffle")
    chance = _histogram(x, moved, reach_us, bin_us, "shuffle").groupBy("series", "bin").agg(F.sum("pairs").alias("s"), F.sum(F.col("pairs") * F.col("pairs")).alias("q"))
    some = y.groupBy("series").agg(F.count_distinct("trial").alias("n")).where("n > 1").select("series")
    out = _histogram(x, y, reach_us, bin_us).join(chance, ["series", "bin"], "full").join(some, "series", "left_semi")
    pairs, mean = F.coalesce("pairs", F.lit(0)), F.coalesce(F.col("s") / shuffles, F.lit(0.0))
    sd = F.sqrt(F.greatest(F.coalesce(F.col("q") / shuffles, F.lit(0.0)) - mean * mean, F.lit(0.0)))
    out = out.select("series", "bin", pairs.alias("pairs"), mean.alias("expected"), (pairs - mean).alias("excess"), sd.alias("sd"))
    return out.withColumn("z", F.when(F.col("sd") > 0, F.col("excess") / F.col("sd")))
