"""Feature reductions, distances, ranks and cluster metrics on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervalia.operators import tiles
from intervalia.sources.shared import written


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def pairs(vectors: DataFrame, within: bool = False) -> DataFrame:
    """i < j, Euclidean distance and labels of all pairs, or of those within a label, in tiles."""
    return tiles.pairs(vectors, tiles.euclidean, within=within)


def sums(vectors: DataFrame, within: bool = False) -> DataFrame:
    """i, li, lj, n, s, q: the Euclidean distances of each vector to those of each label, added up in tiles."""
    return tiles.sums(vectors, within=within)


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", "li", "lj", "d").union(edges.select("j", "i", "lj", "li", "d"))


def correlation(x: Column, y: Column) -> Column:
    """The correlation of an aggregate, null where either is constant, for which F.corr divides by zero."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def reductions(frames: DataFrame) -> DataFrame:
    """The ten reductions of a sampled series: moments, extremes, attack, sustain, release, trend, places."""
    n = F.count("x")
    sorted_x = F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"])
    each = frames.groupBy("vec_id").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.max("x").alias("max"), F.min("x").alias("min"), n.alias("n"), sorted_x.alias("s"), F.coalesce(correlation(F.col("x"), F.col("k")), F.lit(0.0)).alias("lintrend"), F.min(F.struct((-F.col("x")).alias("x"), "k"))["k"].alias("peak"), F.min(F.struct("x", "k"))["k"].alias("trough"))
    at = lambda share: F.element_at("s", F.ceil(F.col("n") * share).cast("int"))
    return each.select("vec_id", "mean", "std", "max", "min", at(0.1).alias("attack"), at(0.5).alias("sustain"), at(0.9).alias("release"), "lintrend", "peak", "trough")


def zscores(frames: DataFrame) -> DataFrame:
    """vec_id, k, z: by column, sample deviation, 0 where it is 0."""
    stats = frames.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    return frames.join(F.broadcast(stats), "k").select("vec_id", "k", F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"))


def empirical(edges: DataFrame, ranges: int = 64) -> DataFrame:
    """Rank over N of each distance, ties by (i, j), without one task for all rows.

    Distances are cut into ranges at percentiles; a row's rank is its rank in the range after the rows of
    the ranges before it. The edges are written to the shared folder once, as they are read three times.
    """
    edges = written(edges, "edges")
    cuts = edges.agg(F.percentile_approx("d", F.lit([k / ranges for k in range(1, ranges)])).alias("cuts"))
    cut = edges.crossJoin(F.broadcast(cuts)).withColumn("g", F.aggregate("cuts", F.lit(0), lambda a, c: a + F.when(c < F.col("d"), 1).otherwise(0))).drop("cuts")
    sizes = cut.groupBy("g").agg(F.count("*").alias("n"))
    sizes = sizes.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("d", "i", "j"))
    return cut.withColumn("r", rank).join(F.broadcast(sizes), "g").withColumn("p", (F.col("before") + F.col("r")) / F.col("all")).drop("g", "r", "before", "all")
