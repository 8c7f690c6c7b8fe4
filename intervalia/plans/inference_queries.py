"""Queries of surrogate tests, factorial designs, correlograms, local regression and line removal (Q, L, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervalia.operators import correlogram, factorial, lines, smoothing, surrogates
from intervalia.plans.registry import query
from intervalia.sources.fixtures import FS, intervals, signals, spread, table, with_

DAY_US = 86_400_000_000
#: Trials of the surrogate tests.
TRIALS = 499


def valued(spark, d, *types: str):
    """Events as rows of the surrogate tests: by user, labelled by type."""
    e = table(spark, d, "events").where(F.col("event_type").isin(*types))
    label = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")) - 1
    return spread(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), label.alias("a"), F.lit(0).alias("b"), F.col("value").alias("y")), "id")


def shipped(spark, d):
    """Line items as rows of two factors, all under one key."""
    x = table(spark, d, "lineitem")
    flag = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1
    return spread(x.select(F.lit(0).alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), flag.alias("a"), (F.col("l_linestatus") == "O").cast("int").alias("b"), F.col("l_quantity").alias("y")), "id")


@query("q05_unpaired_permutation")
def q05_t(spark, d):
    """Values of views against those of purchases of each user, labels permuted."""
    return surrogates.judged(surrogates.two_sample_t(surrogates.permuted(valued(spark, d, "view", "purchase"), TRIALS)))


@query("q05_one_way_permutation")
def q05_one(spark, d):
    """Values by the five types of events of each user, labels permuted."""
    return surrogates.one_way_tested(valued(spark, d, "click", "error", "purchase", "signup", "view"), TRIALS)


@query("q05_one_way_bootstrap")
def q05_boot(spark, d):
    """The same with types drawn from all events of the user."""
    return surrogates.one_way_tested(valued(spark, d, "click", "error", "purchase", "signup", "view"), TRIALS, bootstrap=True)


@query("q05_two_way_permutation")
def q05_two(spark, d):
    """Quantities by return flag and line status, labels permuted in blocks: one key that holds all rows."""
    return surrogates.judged(surrogates.two_way_f(surrogates.permuted(shipped(spark, d), 199)))


FACTORS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def quantities(spark, d):
    return table(spark, d, "lineitem").select(*FACTORS, F.col("l_quantity").cast("double").alias("x"))


@query("q04_n_way_anova")
def q04_n(spark, d):
    """Quantity by return flag, line status and line number with all interactions of two, as a general linear model."""
    return factorial.n_way(quantities(spark, d), FACTORS)


@query("q04_three_way_unweighted", factorial.unweighted_sql(FACTORS, "SELECT l_returnflag, l_linestatus, l_linenumber, CAST(l_quantity AS DOUBLE) AS x FROM lineitem"))
def q04_three(spark, d):
    """The same design with its interaction of three by unweighted means."""
    return factorial.unweighted(quantities(spark, d), FACTORS)


def of_type(spark, d, kind: str):
    return intervals(spark, d, kind).select("series", F.col("start_us").alias("t_us"))


HOUR_US = 3_600_000_000
CROSS = (6 * HOUR_US, HOUR_US, 3 * DAY_US)


@query(
    "q17_cross_correlogram",
    with_("iv")
    + f"""
SELECT a.series, CAST(floor((b.start_us - a.start_us) / CAST({HOUR_US} AS DOUBLE)) AS BIGINT) AS bin, count(*) AS pairs FROM iv AS a JOIN iv AS b ON a.series = b.series
AND a.type = 'view' AND b.type = 'purchase' AND a.start_us // {CROSS[2]} = b.start_us // {CROSS[2]} AND abs(b.start_us - a.start_us) <= {CROSS[0]} GROUP BY ALL""",
)
def q17_raw(spark, d):
    """Purchases about views of each user, by the hour of the lag, within trials of three days."""
    return correlogram.raw(of_type(spark, d, "view"), of_type(spark, d, "purchase"), *CROSS)


@query("q17_correlogram_against_shuffles")
def q17_shuffled(spark, d):
    """The same less what trials of the same user have in common, by twenty shuffles."""
    return correlogram.against_shuffles(of_type(spark, d, "view"), of_type(spark, d, "purchase"), *CROSS)


NEIGHBOURS = [12, 24, 48]


def local(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / DAY_US).alias("x"), F.col("value").alias("y"))
    return smoothing.regressions(e, NEIGHBOURS, 1.0)


@query("l01_local_regression")
def l01(spark, d):
    """The value of events over time by user: local parabolas over as many neighbours as cross-validation takes, with limits."""
    return smoothing.smoothed(local(spark, d))


@query("l02_neighbours_by_cross_validation")
def l02(spark, d):
    """What cross-validation says of each number of neighbours."""
    return smoothing.cross_validation(local(spark, d))


@query("l03_local_predictions")
def l03(spark, d):
    """The local parabola of 24 events of each user at noon of every day."""
    e = table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / DAY_US).alias("x"), F.col("value").alias("y"))
    days = e.groupBy("series").agg(F.floor(F.min("x")).alias("a"), F.floor(F.max("x")).alias("b"))
    noon = days.select("series", F.explode(F.sequence("a", "b")).alias("id")).withColumn("x", F.col("id") + 0.5)
    return smoothing.predicted(e, noon, 24, 1.0)


def with_hum(spark, d):
    """Signals with a sine of 60 Hz as strong as four times what they have themselves."""
    power = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x")
    hum = F.transform("x", lambda v, k: v + 4 * F.sqrt(2 * power) * F.sin(2 * F.pi() * 60 * k / FS))
    return signals(spark, d).select("sid", hum.alias("x"))


@query("d25_line_removal")
def d25(spark, d):
    """Signals with a hum, less all lines that an F test finds in windows of 256 samples."""
    return lines.without_lines(with_hum(spark, d), 256, 128, FS)


@query("d26_significant_lines")
def d26(spark, d):
    """The lines of the windows of the signals as they are."""
    return lines.lines(signals(spark, d), 256, 128, FS)
