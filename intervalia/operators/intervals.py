"""Interval algebra: every function takes and returns DataFrames of series, start_us, stop_us."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervalia.operators.rangejoin import overlap_join

MINUTE = 60_000_000
HOUR = 60 * MINUTE


def order(key: str = "series", *more: str) -> Window:
    return Window.partitionBy(key).orderBy("start_us", *(more or ("id",)))


def blank(spark, n: int) -> DataFrame:
    """n blank events, numbered from 1."""
    empty = F.lit(None).cast("long")
    return spark.range(1, n + 1).select("id", empty.alias("series"), F.lit("").alias("type"), empty.alias("start_us"), empty.alias("stop_us"))


def indexed(df: DataFrame, fs: float) -> DataFrame:
    """Sample indices of both ends: floor(seconds * fs), in whole arithmetic."""
    return df.withColumns({f"idx_{x}": F.expr(f"({x}_us * {int(fs)}L - pmod({x}_us * {int(fs)}L, 1000000L)) div 1000000L") for x in ("start", "stop")})


def padded(df: DataFrame, before_us: int, after_us: int) -> DataFrame:
    return df.withColumns({"start_us": F.greatest(F.lit(0), F.col("start_us") - max(before_us, 0)), "stop_us": F.col("stop_us") + max(after_us, 0)})


def shifted(df: DataFrame, by_us: int) -> DataFrame:
    return df.withColumns({"start_us": F.col("start_us") + by_us, "stop_us": F.col("stop_us") + by_us})


def merge_gaps(df: DataFrame, gap_us: int) -> DataFrame:
    """Groups of intervals whose start is at most gap after the previous row's stop: start, stop, n."""
    w = order()
    new = F.coalesce((F.col("start_us") - F.lag("stop_us").over(w) > gap_us).cast("int"), F.lit(1))
    grouped = df.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w))
    return grouped.groupBy("series", "grp").agg(F.min("start_us").alias("start_us"), F.max("stop_us").alias("stop_us"), F.count("*").alias("n"))


def union(df: DataFrame, closed: bool = True) -> DataFrame:
    """Islands of overlapping intervals, with the type of the first; touching ones join if closed."""
    w = order()
    reach = F.max("stop_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start_us") > reach if closed else F.col("start_us") >= reach
    islands = df.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("island", F.sum("_new").over(w))
    return islands.groupBy("series", "island").agg(F.min("start_us").alias("start_us"), F.max("stop_us").alias("stop_us"), F.count("*").alias("n"), F.min(F.struct("start_us", "id", "type"))["type"].alias("type"))


def resolved(df: DataFrame) -> DataFrame:
    """Intervals without those that do not end after their start, overlapping and touching ones merged."""
    return union(df.where("stop_us > start_us"))


def warped(points: DataFrame, controls: DataFrame, key: str) -> DataFrame:
    """points (key, t) with warped: t by linear interpolation between the controls (x to y) of its key.

    Controls at one x count once, with their least y. Points before the first or after the last are left out.
    """
    w = Window.partitionBy(key).orderBy("x")
    c = controls.groupBy(key, "x").agg(F.min("y").alias("y")).withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where("nx IS NOT NULL")
    met = points.join(c, key).where("t >= x AND t < nx")
    return met.select(key, "t", (F.col("y") + (F.col("ny") - F.col("y")) * ((F.col("t") - F.col("x")) / (F.col("nx") - F.col("x")))).alias("warped"))


def _sweep(a: DataFrame, b: DataFrame) -> DataFrame:
    """Segments between neighbouring bounds of two sets of intervals, with what covers them (1, 2 or 3)."""
    bounds = None
    for df, k in ((a, 1), (b, 2)):
        flat = union(df).select("series", F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(k).alias("d")), F.struct(F.col("stop_us").alias("t"), F.lit(-k).alias("d")))).alias("e"))
        bounds = flat if bounds is None else bounds.union(flat)
    steps = bounds.groupBy("series", F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("series").orderBy("t")
    return steps.select("series", F.col("t").alias("start_us"), F.lead("t").over(w).alias("stop_us"), F.sum("d").over(w).alias("cover")).where("stop_us IS NOT NULL")


def covered(a: DataFrame, b: DataFrame, cover: int) -> DataFrame:
    """Maximal times covered by both (3), by a alone (1) or by b alone (2)."""
    s = _sweep(a, b).where(F.col("cover") == cover)
    w = Window.partitionBy("series").orderBy("start_us")
    s = s.withColumn("g", F.sum(F.coalesce((F.col("start_us") != F.lag("stop_us").over(w)).cast("int"), F.lit(1))).over(w))
    return s.groupBy("series", "g").agg(F.min("start_us").alias("start_us"), F.max("stop_us").alias("stop_us")).drop("g")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return covered(a, b, 3)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return covered(a, b, 1)


def self_overlaps(df: DataFrame, width: int = HOUR) -> DataFrame:
    """Each overlapping pair once, with the shared area; touching is no overlap."""
    p = overlap_join(df, df, width).where("a_id < b_id")
    return p.select(F.col("a_series").alias("series"), F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), F.greatest("a_start_us", "b_start_us").alias("start_us"), F.least("a_stop_us", "b_stop_us").alias("stop_us"))


def parent_of(children: DataFrame, parents: DataFrame, margin_us: int = 20_000, width: int = HOUR) -> DataFrame:
    """id and the first parent that contains the child within a soft margin, or null."""
    p = overlap_join(parents, children, width, margin=margin_us)
    p = p.where((F.col("a_start_us") - margin_us < F.col("b_start_us")) & (F.col("b_stop_us") < F.col("a_stop_us") + margin_us))
    first = p.groupBy(F.col("b_id").alias("id")).agg(F.min(F.struct("a_start_us", "a_id"))["a_id"].alias("parent"))
    return children.select("id", "series", "start_us", "stop_us", "type").join(first, "id", "left")


def nearest(df: DataFrame, others: DataFrame) -> DataFrame:
    """id and near: the other interval of the series whose end is nearest to the start, or whose start is nearest to the end.

    The others before and after each time come from one window over the times of both, so no pairs are made. Ties
    go to the smaller id; series without others give no row.
    """
    best = None
    for own, far in (("start_us", "stop_us"), ("stop_us", "start_us")):
        times = df.select("series", F.col(own).alias("t"), "id", F.lit(None).cast("long").alias("b"))
        times = times.union(others.select("series", F.col(far).alias("t"), F.lit(None).cast("long").alias("id"), F.col("id").alias("b")))
        w = Window.partitionBy("series").orderBy("t")
        known = lambda sign: F.when(F.col("b").isNotNull(), F.struct(F.col("t"), (sign * F.col("b")).alias("k")))
        times = times.select("id", "t", F.max(known(-1)).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("p"), F.min(known(1)).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("q")).where("id IS NOT NULL")
        two = F.array(F.struct((F.col("t") - F.col("p.t")).alias("gap"), (-F.col("p.k")).alias("near")), F.struct((F.col("q.t") - F.col("t")).alias("gap"), F.col("q.k").alias("near")))
        each = times.select("id", F.inline(two)).where("near IS NOT NULL")
        best = each if best is None else best.union(each)
    return best.groupBy("id").agg(F.min(F.struct("gap", "near"))["near"].alias("near"))


def windows(df: DataFrame, n: int, overlap_us: int) -> DataFrame:
    """n equal windows of each interval, overlapping by overlap_us."""
    size = F.floor((F.col("stop_us") - F.col("start_us") + (n - 1) * overlap_us) / n)
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "series", "k", (F.col("start_us") + F.col("k") * (size - overlap_us)).alias("start_us"), (F.col("start_us") + F.col("k") * (size - overlap_us) + size).alias("stop_us"))


def gaps(df: DataFrame) -> DataFrame:
    """Silences between the islands of a series."""
    w = Window.partitionBy("series").orderBy("start_us")
    u = union(df)
    return u.select("series", F.col("stop_us").alias("start_us"), F.lead("start_us").over(w).alias("stop_us")).where("stop_us > start_us")


def grid(lo: Column, hi: Column, step: int) -> Column:
    """Multiples of step in [lo, hi]."""
    a, b = F.ceil(lo / step), F.floor(hi / step)
    return F.when(a <= b, F.transform(F.sequence(a, b), lambda x: x * step)).otherwise(F.array().cast("array<bigint>"))
