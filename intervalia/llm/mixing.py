"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Targets: the sources, in code-point order with null last, get weights that repeat, a budget shared by
weight, and a ceiling of so many times their size; what is above a ceiling is shared again by weight.

Selection: every document has a 64-bit hash. A source's target is a whole number of passes over it
and a rest; the rest is taken from the documents whose hash is at or below a threshold. The threshold
is found by sums of sizes by source and hash bucket: the bucket in which the rest runs out is the only
one that the next level looks at, with finer buckets. Nothing is sorted, and a smaller budget takes a
subset of what a larger one takes.

What a source takes differs from its target by at most half of the document at its threshold, so by at most half of its
longest document; one document that holds most of a source's words makes that much.

Null, blank and empty texts have size 0 and are taken as nothing; very long ones count whole. Rows with equal doc_id, source
and size, such as repeated ones, have the same hash and share one decision. Null doc_ids are ids like others. An
empty table gives an empty mix. keep() keeps all columns, whatever their names; mix() reads doc_id, source and text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervalia.llm.common import n_words, saved

WEIGHTS = (5, 2, 1)
#: Bits of the hash that a level of the histograms resolves; five levels resolve 60 bits.
BITS = 12
LEVELS = 5


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, source_size and target of each source; sizes has source and size.

    The ceilings are passed in ascending order of ceiling per weight: the targets are
    min(ceiling, weight * level), with the level at which they add up to the budget.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    each = each.withColumn("w", F.get(w, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    each = each.withColumn("cap", ceiling * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_of = Window.partitionBy()
    each = each.withColumn("total", budget * F.sum("source_size").over(all_of))
    each = each.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the level is that of the first source whose ceiling is not below it
    each = each.withColumn("k", F.row_number().over(order))
    each = each.withColumn("fit", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(all_of)["level"])
    each = each.withColumn("target", F.least(F.col("cap"), F.col("w") * F.coalesce("fit", F.lit(float("inf")))))
    return each.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))


def _thresholds(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, threshold: the unsigned 60-bit hash at or below which the rest of each source is taken."""
    open_ = wanted.select("source", F.col("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        here = items.alias("i").join(open_.alias("o"), F.col("i.source").eqNullSafe(F.col("o.source")))
        if level:
            here = here.where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = here.groupBy("i.source", "rest", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.col("below") + F.sum("n").over(run))
        # the boundary bucket is the first whose sum reaches the rest, or the last
        edge = sums.withColumn("reach", F.coalesce(F.min(F.when(F.col("upto") >= F.col("rest"), F.col("bucket"))).over(Window.partitionBy("source")), F.max("bucket").over(Window.partitionBy("source"))))
        edge = edge.where(F.col("bucket") == F.col("reach"))
        open_ = saved(edge.select("source", "rest", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("n")).alias("below"), "upto"), "mix-level")
    near = (F.col("upto") - F.col("rest")) <= (F.col("rest") - F.col("below"))
    return open_.select("source", F.when(near, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def _hash(seed: int):
    """60 bits, unsigned."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "size"), 4)


def plan(items: DataFrame, weights=WEIGHTS, budget: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """A row for each source: source, source_size, target, full (whole passes) and threshold.

    items has source, size and h.
    """
    goal = targets(items, weights, budget, ceiling)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = saved(goal.withColumn("full", full.cast("int")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-goal")
    cut = _thresholds(items.where("size > 0"), goal.where("rest > 0").select("source", "rest"))
    both = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
    return saved(both.select("g.source", "source_size", "target", "full", F.coalesce("threshold", F.lit(-1).cast("long")).alias("threshold")), "mix-plan")


def _copies(items: DataFrame, goal: DataFrame) -> DataFrame:
    """items with source_size, target and copies; Spark broadcasts the plan only while it is small."""
    goal = goal.withColumnRenamed("source", "_source")
    out = items.join(goal, items["source"].eqNullSafe(goal["_source"])).drop("_source")
    copies = F.when(F.col("size") > 0, F.col("full") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)).otherwise(0)
    return out.withColumn("copies", copies).drop("full", "threshold", "h")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, ceiling: float = 2.0, seed: int = 20240) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of docs."""
    items = docs.select("doc_id", "source", n_words().alias("size"))
    items = saved(items.withColumn("h", _hash(seed)), "mix-items")
    out = _copies(items, plan(items, weights, budget, ceiling))
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def keep(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, ceiling: float = 2.0, seed: int = 20240) -> DataFrame:
    """The rows of docs that the mix takes, repeated as often as it takes them, with the columns of docs.

    Rows without words are dropped. The rows meet the plan by source, so no text is shuffled.
    """
    items = saved(docs.select("doc_id", "source", n_words().alias("size")).withColumn("h", _hash(seed)), "mix-items")
    goal = plan(items, weights, budget, ceiling)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    each = docs.select(row, "doc_id", "source", n_words().alias("size")).withColumn("h", _hash(seed))
    each = _copies(each, goal).where("copies > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_n")).select("row.*")
