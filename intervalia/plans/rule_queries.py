"""Queries of small rules on intervals, records, thresholds and factorial designs (E, R, D, T, Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from intervalia.operators import factorial
from intervalia.operators import intervals as I
from intervalia.operators.rangejoin import overlap_join, points_in
from intervalia.plans.interval_queries import GAPS, IV, UNION
from intervalia.plans.registry import query
from intervalia.sources.fixtures import SQL, frames, intervals, points, table, vectors, with_

R = F.round
VE, FR = with_("ve"), with_("fr")


@query("e01_blank_events", "SELECT unnest(range(1, 9)) AS id, CAST(NULL AS BIGINT) AS series, '' AS type, CAST(NULL AS BIGINT) AS start_us, CAST(NULL AS BIGINT) AS stop_us")
def e01(spark, d):
    return I.blank(spark, 8)


@query("e27_derived_motifs", GAPS.format(gap=300_000) + " SELECT series, greatest(0, start_us - 50000) AS start_us, stop_us, n, 'BOS' AS type FROM m")
def e27(spark, d):
    return I.padded(I.merge_gaps(intervals(spark, d), 300_000), 50_000, 0).drop("grp").withColumn("type", F.lit("BOS"))


SHRUNK = "WITH " + SQL["iv"].replace("iv AS", "iv0 AS", 1) + ", iv AS (SELECT id, series, type, start_us, stop_us - 600000000 AS stop_us FROM iv0 WHERE stop_us - 600000000 > start_us)"


@query("e29_resolve_overlaps", SHRUNK + UNION.format(t="a", where="true") + " SELECT series, start_us, stop_us, n FROM u_a")
def e29(spark, d):
    x = intervals(spark, d).withColumn("stop_us", F.col("stop_us") - 10 * I.MINUTE)
    return I.resolved(x).select("series", "start_us", "stop_us", "n")


@query("r02_assign_and_copy", IV + " SELECT p.id, p.type, p.start_us AS mark_us, n.id AS next_id FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY start_us, id) AS k FROM iv) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY start_us, id) AS k FROM iv) n ON n.series = p.series AND n.k = p.k + 1")
def r02(spark, d):
    return intervals(spark, d).select("id", "type", F.col("start_us").alias("mark_us"), F.lead("id").over(I.order()).alias("next_id"))


@query("r06_even_distribution", "WITH n AS (SELECT user_id AS series, count(*) AS n FROM events GROUP BY 1), g AS (SELECT series, n, unnest(range(0, 5)) AS g FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY (series * 7919 + g * 104729) % 10007, g) AS k FROM g) SELECT series, g, n // 5 + CASE WHEN k <= n % 5 THEN 1 ELSE 0 END AS share FROM k")
def r06(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("series")).agg(F.count("*").alias("n"))
    g = n.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    w = Window.partitionBy("series").orderBy((F.col("series") * 7919 + F.col("g") * 104729) % 10007, "g")
    return g.select("series", "g", (F.floor(F.col("n") / 5) + (F.row_number().over(w) <= F.col("n") % 5).cast("long")).alias("share"))


SESSION = "SELECT o_orderkey, 'C' || (o_custkey % 100) || '_' || strftime(o_orderdate, '%m_%d') || '_' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS session FROM orders"


@query("r11_session_parts", f"SELECT o_orderkey, split_part(session, '_', 1) AS subject, split_part(session, '_', 2) || '_' || split_part(session, '_', 3) AS date_part, CAST(split_part(session, '_', 4) AS BIGINT) AS number FROM ({SESSION})")
def r11(spark, d):
    o = table(spark, d, "orders")
    name = F.concat_ws("_", F.concat(F.lit("C"), (F.col("o_custkey") % 100).cast("string")), F.date_format("o_orderdate", "MM_dd"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    o = o.select("o_orderkey", F.split(name, "_").alias("p"))
    at = lambda k: F.get("p", F.lit(k))
    return o.select("o_orderkey", at(0).alias("subject"), F.concat_ws("_", at(1), at(2)).alias("date_part"), at(3).cast("long").alias("number"))


# a quiet stretch: lengths shrink by 0.8 from 16 frames while none fits

SIZES = [16, 12, 10, 8, 6, 5]


@query("d07_quiet_stretch", VE + f", c AS (SELECT vec_id, v, unnest({SIZES}) AS n FROM ve), s AS (SELECT vec_id, v, n, unnest(range(1, 66 - n)) AS k FROM c), q AS (SELECT vec_id, n, k FROM s WHERE NOT list_bool_or([abs(x) > 0.3 for x in v[k:k + n - 1]]) AND list_max(v[k:k + n - 1]) - list_min(v[k:k + n - 1]) < 0.35 AND round(list_stddev_samp(v[k:k + n - 1]), 9) < 0.1) SELECT vec_id, arg_min(k, (-n, k)) AS k0, max(n) AS n FROM q GROUP BY vec_id")
def d07(spark, d):
    c = vectors(spark, d).withColumn("n", F.explode(F.array(*[F.lit(n) for n in SIZES])))
    c = c.withColumn("k", F.explode(F.sequence(F.lit(1), 65 - F.col("n")))).withColumn("w", F.slice("v", F.col("k"), F.col("n")))
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    square = F.aggregate("w", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m")))
    c = c.withColumn("m", mean).withColumn("s", R(F.sqrt(square / (F.col("n") - 1)), 9))
    quiet = c.where((F.array_max(F.transform("w", F.abs)) <= 0.3) & (F.array_max("w") - F.array_min("w") < 0.35) & (F.col("s") < 0.1))
    return quiet.groupBy("vec_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "k"))["k"].alias("k0"), F.max("n").alias("n"))


# label-based warp of points in a parent, by the first child of each label

WARP = (
    "WITH " + SQL["iv"] + ", " + SQL["pt"] + ", p AS (SELECT id AS parent, series, start_us, stop_us FROM iv WHERE type = 'purchase'),"
    " c AS (SELECT p.parent, i.type AS label, i.start_us - p.start_us AS a, i.stop_us - p.start_us AS b, row_number() OVER (PARTITION BY p.parent, i.type ORDER BY i.start_us, i.id) AS k FROM p JOIN iv i ON i.series = p.series AND i.type IN ('click', 'view') AND i.start_us >= p.start_us - 3600000000 AND i.stop_us <= p.stop_us + 3600000000),"
    " m AS (SELECT label, avg(a) AS ma, avg(b - a) AS ml FROM c GROUP BY label),"
    " k0 AS (SELECT parent, label, unnest([a, b]) AS x, unnest([ma, ma + ml]) AS y FROM c JOIN m USING (label) WHERE k = 1),"
    " k1 AS (SELECT parent, x, min(y) AS y FROM k0 GROUP BY ALL),"
    " k2 AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY x) AS r, lead(x) OVER (PARTITION BY parent ORDER BY x) AS nx, lead(y) OVER (PARTITION BY parent ORDER BY x) AS ny FROM k1),"
    " t AS (SELECT p.parent, q.t_us - p.start_us AS t FROM p JOIN pt q ON q.series = p.series AND q.t_us BETWEEN p.start_us - 3600000000 AND p.stop_us + 3600000000)"
)


@query("t04_label_warp", WARP + " SELECT t.parent, t.t, round(k2.y + (k2.ny - k2.y) * ((t.t - k2.x) / (k2.nx - k2.x)), 3) AS warped FROM t JOIN k2 ON k2.parent = t.parent AND k2.nx IS NOT NULL AND t.t >= k2.x AND t.t < k2.nx")
def t04(spark, d):
    wide = I.HOUR
    x = intervals(spark, d)
    p = x.where("type = 'purchase'").select(F.col("id").alias("parent"), "series", (F.col("start_us") - wide).alias("start_us"), (F.col("stop_us") + wide).alias("stop_us"))
    begin = F.col("start_us") + wide
    c = overlap_join(p.withColumnRenamed("parent", "id"), x.where("type IN ('click', 'view')"), I.HOUR, closed=True).where("b_start_us >= a_start_us AND b_stop_us <= a_stop_us")
    c = c.select(F.col("a_id").alias("parent"), F.col("b_type").alias("label"), (F.col("b_start_us") - F.col("a_start_us") - wide).alias("a"), (F.col("b_stop_us") - F.col("a_start_us") - wide).alias("b"), "b_start_us", "b_id")
    means = c.groupBy("label").agg(F.avg("a").alias("ma"), F.avg(F.col("b") - F.col("a")).alias("ml"))
    first = c.groupBy("parent", "label").agg(F.min(F.struct("b_start_us", "b_id", "a", "b")).alias("f")).join(F.broadcast(means), "label")
    both = F.array(F.struct(F.col("f.a").alias("x"), F.col("ma").alias("y")), F.struct(F.col("f.b").alias("x"), (F.col("ma") + F.col("ml")).alias("y")))
    return I.warped(points_in(p, points(spark, d), I.HOUR).select("parent", (F.col("t_us") - begin).alias("t")), first.select("parent", F.inline(both)), "parent").select("parent", "t", R("warped", 3).alias("warped"))


# thresholds, lines, factorial designs


@query("q10_line_fit", "SELECT event_type, round(regr_slope(value, x), 9) AS slope, round(regr_intercept(value, x), 6) AS intercept, count(*) AS n FROM (SELECT event_type, value, CAST(event_id % 1000 AS DOUBLE) AS x FROM events) GROUP BY event_type")
def q10(spark, d):
    e = table(spark, d, "events").withColumn("x", (F.col("event_id") % 1000).cast("double"))
    return e.groupBy("event_type").agg(R(F.regr_slope("value", "x"), 9).alias("slope"), R(F.regr_intercept("value", "x"), 6).alias("intercept"), F.count("*").alias("n"))


@query("q13_family_thresholds", "WITH m AS (SELECT series, count(DISTINCT type) AS m FROM (SELECT user_id AS series, event_type AS type FROM events) GROUP BY series) SELECT series, m, round(1 - pow(0.95, 1.0 / m), 9) AS sidak, round(0.05 / m, 9) AS bonferroni FROM m")
def q13(spark, d):
    m = table(spark, d, "events").groupBy(F.col("user_id").alias("series")).agg(F.count_distinct("event_type").alias("m"))
    return m.select("series", "m", R(1 - F.pow(F.lit(0.95), 1.0 / F.col("m")), 9).alias("sidak"), R(0.05 / F.col("m"), 9).alias("bonferroni"))


#: Sums of squares of cell means, each cell weighing the harmonic mean of the cell sizes; `f` has a, b, x.
TWO_WAY = (
    ", c AS (SELECT a, b, count(*) AS n, avg(x) AS m, sum(x * x) - sum(x) * sum(x) / count(*) AS ss FROM f GROUP BY a, b),"
    " w AS (SELECT count(*) / sum(1.0 / n) AS h, count(DISTINCT a) AS na, count(DISTINCT b) AS nb, avg(m) AS g, sum(ss) AS sse, sum(n) AS n FROM c),"
    " d AS (SELECT c.m, avg(c.m) OVER (PARTITION BY c.a) AS ra, avg(c.m) OVER (PARTITION BY c.b) AS rb, w.* FROM c, w),"
    " s AS (SELECT any_value(h) * sum((ra - g) * (ra - g)) AS sa, any_value(h) * sum((rb - g) * (rb - g)) AS sb, any_value(h) * sum((m - ra - rb + g) * (m - ra - rb + g)) AS sab, any_value(na) - 1 AS da, any_value(nb) - 1 AS db, any_value(sse) AS sse, any_value(n) - any_value(na) * any_value(nb) AS de FROM d)"
    " SELECT e.effect, CAST(e.df AS BIGINT) AS df, CAST(s.de AS BIGINT) AS df_error, round((e.ss / e.df) / (s.sse / s.de), 6) AS F FROM s, LATERAL (SELECT unnest(['a', 'b', 'ab']) AS effect, unnest([sa, sb, sab]) AS ss, unnest([da, db, da * db]) AS df) e"
)


@query("q04_two_way_anova", "WITH f AS (SELECT o_orderstatus AS a, o_orderpriority AS b, o_totalprice / 1000 AS x FROM orders)" + TWO_WAY)
def q04(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), (F.col("o_totalprice") / 1000).alias("x"))
    return factorial.two_way(f).withColumn("F", R("F", 6))


@query("q18_coded_factors", "WITH f AS (SELECT CAST(l_returnflag = 'N' AS INT) AS a, CAST(l_discount > 0.05 AS INT) AS b, l_extendedprice / 1000 AS x FROM lineitem)" + TWO_WAY)
def q18(spark, d):
    f = table(spark, d, "lineitem").select((F.col("l_returnflag") == "N").cast("int").alias("a"), (F.col("l_discount") > 0.05).cast("int").alias("b"), (F.col("l_extendedprice") / 1000).alias("x"))
    return factorial.two_way(f).withColumn("F", R("F", 6))


@query("q04_repeated_measures", "WITH f AS (SELECT vec_id % 50 AS s, label % 2 AS a, k % 4 AS b, avg(x) AS x FROM (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL), c AS (SELECT *, avg(x) OVER (PARTITION BY a, b) AS ab, avg(x) OVER (PARTITION BY a) AS ma, avg(x) OVER (PARTITION BY b) AS mb, avg(x) OVER (PARTITION BY s) AS ms, avg(x) OVER (PARTITION BY s, a) AS sa, avg(x) OVER (PARTITION BY s, b) AS sb, avg(x) OVER () AS g FROM f), n AS (SELECT count(DISTINCT s) AS ns, count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM f), t AS (SELECT sum((ma - g) ** 2) / (any_value(na) - 1) AS a1, sum((sa - ms - ma + g) ** 2) / ((any_value(na) - 1) * (any_value(ns) - 1)) AS a0, sum((mb - g) ** 2) / (any_value(nb) - 1) AS b1, sum((sb - ms - mb + g) ** 2) / ((any_value(nb) - 1) * (any_value(ns) - 1)) AS b0, sum((ab - ma - mb + g) ** 2) / ((any_value(na) - 1) * (any_value(nb) - 1)) AS ab1, sum((x - sa - sb - ab + ma + mb + ms - g) ** 2) / ((any_value(na) - 1) * (any_value(nb) - 1) * (any_value(ns) - 1)) AS ab0 FROM c, n) SELECT unnest(['a', 'b', 'ab']) AS effect, round(unnest([a1 / a0, b1 / b0, ab1 / ab0]), 4) AS F FROM t")
def q04_repeated(spark, d):
    f = frames(spark, d).groupBy((F.col("vec_id") % 50).alias("s"), (F.col("label") % 2).alias("a"), (F.col("k") % 4).alias("b")).agg(F.avg("x").alias("x"))
    return factorial.repeated(f).withColumn("F", R("F", 4))
