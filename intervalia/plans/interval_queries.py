"""Queries of the interval algebra (E, R, S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from intervalia.operators import intervals as I
from intervalia.operators.rangejoin import overlap_join
from intervalia.plans.registry import query
from intervalia.sources.fixtures import intervals, table, with_

IV, M = with_("iv"), I.MINUTE
COLS = ["id", "series", "start_us", "stop_us"]


@query("e02_index_from_times", IV + " SELECT id, start_us * 1000 // 1000000 AS idx_start, stop_us * 1000 // 1000000 AS idx_stop FROM iv")
def e02(spark, d):
    return I.indexed(intervals(spark, d), 1000).select("id", "idx_start", "idx_stop")


@query("e03_times_from_index", IV + " SELECT id, round((start_us // 1000) / 1000.0, 3) AS start_s, round((stop_us // 1000) / 1000.0, 3) AS stop_s FROM iv")
def e03(spark, d):
    x = I.indexed(intervals(spark, d), 1000)
    return x.select("id", F.round(F.col("idx_start") / 1000.0, 3).alias("start_s"), F.round(F.col("idx_stop") / 1000.0, 3).alias("stop_s"))


@query("e04_pad", IV + " SELECT id, greatest(0, start_us - 30000) AS start_us, stop_us + 30000 AS stop_us FROM iv")
def e04(spark, d):
    return I.padded(intervals(spark, d), 30_000, 30_000).select("id", "start_us", "stop_us")


@query("e05_shift", IV + " SELECT id, type, start_us - 5000000 AS start_us, stop_us - 5000000 AS stop_us FROM iv")
def e05(spark, d):
    return I.shifted(intervals(spark, d), -5_000_000).select("id", "type", "start_us", "stop_us")


@query("e06_sort_permutation", IV + " SELECT id, row_number() OVER (PARTITION BY series ORDER BY stop_us - start_us DESC, id) AS place FROM iv")
def e06(spark, d):
    w = Window.partitionBy("series").orderBy((F.col("stop_us") - F.col("start_us")).desc(), "id")
    return intervals(spark, d).select("id", F.row_number().over(w).alias("place"))


@query("e07_basic_columns", IV + " SELECT id, series, type, start_us, stop_us FROM iv WHERE stop_us > start_us")
def e07(spark, d):
    return intervals(spark, d).where("stop_us > start_us")


@query("e08_length", IV + " SELECT id, stop_us - start_us AS length_us FROM iv")
def e08(spark, d):
    return intervals(spark, d).select("id", (F.col("stop_us") - F.col("start_us")).alias("length_us"))


@query("e09_bookends", IV + " SELECT series, min(start_us) AS start_us, max(stop_us) AS stop_us FROM iv GROUP BY series")
def e09(spark, d):
    return intervals(spark, d).groupBy("series").agg(F.min("start_us").alias("start_us"), F.max("stop_us").alias("stop_us"))


GAPS = IV + ", a AS (SELECT *, CASE WHEN start_us - lag(stop_us) OVER w > {gap} OR lag(stop_us) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM iv WINDOW w AS (PARTITION BY series ORDER BY start_us, id)), g AS (SELECT *, sum(f) OVER (PARTITION BY series ORDER BY start_us, id) AS grp FROM a), m AS (SELECT series, grp, min(start_us) AS start_us, max(stop_us) AS stop_us, count(*) AS n FROM g GROUP BY ALL)"


@query("e10_merge_gaps", GAPS.format(gap=30 * M) + " SELECT series, start_us, stop_us, n FROM m")
def e10(spark, d):
    return I.merge_gaps(intervals(spark, d), 30 * M).drop("grp")


@query("e10_bouts_per_user_day", GAPS.format(gap=120 * M) + " SELECT series, start_us // 86400000000 AS day, count(*) AS bouts, sum(n)::BIGINT AS members, sum(stop_us - start_us)::BIGINT AS total_us FROM m GROUP BY ALL")
def e10_day(spark, d):
    b = I.merge_gaps(intervals(spark, d), 120 * M).withColumn("day", F.floor(F.col("start_us") / 86_400_000_000))
    return b.groupBy("series", "day").agg(F.count("*").alias("bouts"), F.sum("n").alias("members"), F.sum(F.col("stop_us") - F.col("start_us")).alias("total_us"))


@query("e11_bouts", GAPS.format(gap=2_000_000) + " SELECT series, start_us, stop_us, n FROM m WHERE n > 1")
def e11(spark, d):
    return I.merge_gaps(intervals(spark, d), 2_000_000).where("n > 1").drop("grp")


UNION = ", u0_{t} AS (SELECT *, CASE WHEN start_us > max(stop_us) OVER (PARTITION BY series ORDER BY start_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM iv WHERE {where}), u1_{t} AS (SELECT *, sum(f) OVER (PARTITION BY series ORDER BY start_us, id) AS island FROM u0_{t}), u_{t} AS (SELECT series, island, min(start_us) AS start_us, max(stop_us) AS stop_us, count(*) AS n, arg_min(type, (start_us, id)) AS type FROM u1_{t} GROUP BY series, island)"


@query("e12_union", IV + UNION.format(t="a", where="true") + " SELECT series, start_us, stop_us, n, type FROM u_a")
def e12(spark, d):
    return I.union(intervals(spark, d)).drop("island")


@query("e13_self_overlaps", IV + " SELECT a.series, a.id AS id1, b.id AS id2, greatest(a.start_us, b.start_us) AS start_us, least(a.stop_us, b.stop_us) AS stop_us FROM iv a JOIN iv b ON a.series = b.series AND a.id < b.id AND a.start_us < b.stop_us AND b.start_us < a.stop_us")
def e13(spark, d):
    return I.self_overlaps(intervals(spark, d))


@query("e14_overlaps_between", IV + " SELECT a.id AS id1, b.id AS id2, least(a.stop_us, b.stop_us) - greatest(a.start_us, b.start_us) AS shared_us FROM iv a JOIN iv b ON a.series = b.series AND a.type = 'purchase' AND b.type = 'click' AND a.start_us < b.stop_us AND b.start_us < a.stop_us")
def e14(spark, d):
    p = overlap_join(intervals(spark, d, "purchase"), intervals(spark, d, "click"), I.HOUR)
    return p.select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), (F.least("a_stop_us", "b_stop_us") - F.greatest("a_start_us", "b_start_us")).alias("shared_us"))


def _cover(k: int) -> str:
    both = UNION.format(t="p", where="type = 'purchase'") + UNION.format(t="c", where="type = 'click'")
    return IV + both + f", e AS (SELECT series, start_us AS t, 1 AS d FROM u_p UNION ALL SELECT series, stop_us, -1 FROM u_p UNION ALL SELECT series, start_us, 2 FROM u_c UNION ALL SELECT series, stop_us, -2 FROM u_c), s AS (SELECT series, t, sum(d) AS d FROM e GROUP BY ALL), x AS (SELECT series, t AS start_us, lead(t) OVER w AS stop_us, sum(d) OVER w AS cover FROM s WINDOW w AS (PARTITION BY series ORDER BY t)), y AS (SELECT *, CASE WHEN start_us = lag(stop_us) OVER (PARTITION BY series ORDER BY start_us) THEN 0 ELSE 1 END AS f FROM x WHERE cover = {k} AND stop_us IS NOT NULL), z AS (SELECT *, sum(f) OVER (PARTITION BY series ORDER BY start_us) AS g FROM y) SELECT series, min(start_us) AS start_us, max(stop_us) AS stop_us FROM z GROUP BY series, g"


@query("e15_intersection", _cover(3))
def e15(spark, d):
    return I.intersection(intervals(spark, d, "purchase"), intervals(spark, d, "click"))


@query("e16_difference", _cover(1))
def e16(spark, d):
    return I.difference(intervals(spark, d, "purchase"), intervals(spark, d, "click"))


@query("e16_difference_reverse", _cover(2))
def e16b(spark, d):
    return I.covered(intervals(spark, d, "purchase"), intervals(spark, d, "click"), 2)


PARENT = IV + ", pa AS (SELECT c.id, c.series, c.start_us, c.stop_us, c.type, arg_min(p.id, (p.start_us, p.id)) AS parent FROM iv c LEFT JOIN iv p ON p.series = c.series AND p.type = 'purchase' AND p.start_us - 20000 < c.start_us AND c.stop_us < p.stop_us + 20000 WHERE c.type IN ('click', 'view') GROUP BY ALL)"


def _parents(spark, d):
    return I.parent_of(intervals(spark, d, "click", "view"), intervals(spark, d, "purchase"))


@query("e17_parent", PARENT + " SELECT id, parent FROM pa")
def e17(spark, d):
    return _parents(spark, d).select("id", "parent")


@query("e18_first_and_last_born", PARENT + " SELECT parent, arg_min(id, (start_us, id)) AS first_id, arg_max(id, (start_us, id)) AS last_id, count(*) AS n FROM pa WHERE parent IS NOT NULL GROUP BY parent")
def e18(spark, d):
    at = F.struct("start_us", "id")
    return _parents(spark, d).where("parent IS NOT NULL").groupBy("parent").agg(F.min(at)["id"].alias("first_id"), F.max(at)["id"].alias("last_id"), F.count("*").alias("n"))


@query("e19_inherit_labels", PARENT + " SELECT id, CASE WHEN parent IS NULL THEN type ELSE 'purchase' END AS type FROM pa")
def e19(spark, d):
    return _parents(spark, d).select("id", F.when(F.col("parent").isNull(), F.col("type")).otherwise("purchase").alias("type"))


@query("e20_contained", IV + " SELECT s.id FROM iv s WHERE s.type = 'click' AND EXISTS (SELECT 1 FROM iv p WHERE p.series = s.series AND p.type = 'purchase' AND p.start_us <= s.start_us AND s.stop_us <= p.stop_us)")
def e20(spark, d):
    p = overlap_join(intervals(spark, d, "purchase"), intervals(spark, d, "click"), I.HOUR, closed=True)
    return p.where("a_start_us <= b_start_us AND b_stop_us <= a_stop_us").select(F.col("b_id").alias("id")).distinct()


@query("e21_split_windows", IV + ", s AS (SELECT id, start_us, (stop_us - start_us + 3 * 2000000) // 4 AS size, unnest([0, 1, 2, 3]) AS k FROM iv WHERE stop_us - start_us > 60000000) SELECT id, k, start_us + k * (size - 2000000) AS start_us, start_us + k * (size - 2000000) + size AS stop_us FROM s")
def e21(spark, d):
    return I.windows(intervals(spark, d).where("stop_us - start_us > 60000000"), 4, 2_000_000).drop("series")


@query("e22_whole_series", IV + " SELECT series, 0 AS start_us, max(stop_us) - min(start_us) AS stop_us FROM iv GROUP BY series")
def e22(spark, d):
    return intervals(spark, d).groupBy("series").agg(F.lit(0).alias("start_us"), (F.max("stop_us") - F.min("start_us")).alias("stop_us"))


@query("e23_check_regions", IV + ", k AS (SELECT id, start_us, start_us * 1000 // 1000000 + CASE WHEN id % 97 = 0 THEN 5 ELSE 0 END AS idx FROM iv), b AS (SELECT bool_and(abs(idx - start_us * 1000 // 1000000) <= 1) AS ok FROM k) SELECT k.id, b.ok, CASE WHEN b.ok THEN idx ELSE start_us * 1000 // 1000000 END AS idx FROM k, b")
def e23(spark, d):
    k = I.indexed(intervals(spark, d), 1000).withColumn("idx", F.col("idx_start") + F.when(F.col("id") % 97 == 0, 5).otherwise(0))
    ok = k.agg(F.bool_and(F.abs(F.col("idx") - F.col("idx_start")) <= 1).alias("ok"))
    return k.crossJoin(F.broadcast(ok)).select("id", "ok", F.when(F.col("ok"), F.col("idx")).otherwise(F.col("idx_start")).alias("idx"))


@query("e24_state_vector", IV + ", g AS (SELECT DISTINCT series, unnest(range((start_us + 599999999) // 600000000, stop_us // 600000000 + 1)) * 600000000 AS t_us FROM iv WHERE type = 'purchase') SELECT series, t_us FROM g")
def e24(spark, d):
    x = intervals(spark, d, "purchase")
    return x.select("series", F.explode(I.grid(F.col("start_us"), F.col("stop_us"), 10 * M)).alias("t_us")).distinct()


@query("e25_baseline", IV + ", k AS (SELECT id, series, start_us - 180000000 AS start_us, start_us - 120000000 AS stop_us FROM iv WHERE type = 'purchase') SELECT k.id, k.start_us, k.stop_us FROM k WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE b.series = k.series AND b.start_us < k.stop_us AND k.start_us < b.stop_us)")
def e25(spark, d):
    k = intervals(spark, d, "purchase").select("id", "series", (F.col("start_us") - 180_000_000).alias("s"), (F.col("start_us") - 120_000_000).alias("stop_us")).withColumnRenamed("s", "start_us")
    hit = overlap_join(k, intervals(spark, d).select(*COLS), I.HOUR).select(F.col("a_id").alias("id")).distinct()
    return k.join(hit, "id", "left_anti").select("id", "start_us", "stop_us")


@query("e26_silences", IV + UNION.format(t="a", where="true") + ", g AS (SELECT series, stop_us AS start_us, lead(start_us) OVER (PARTITION BY series ORDER BY start_us) AS stop_us FROM u_a) SELECT series, start_us, stop_us, (stop_us - start_us) // 3600000000 AS tiles FROM g WHERE stop_us > start_us")
def e26(spark, d):
    return I.gaps(intervals(spark, d)).withColumn("tiles", F.floor((F.col("stop_us") - F.col("start_us")) / I.HOUR))


@query("e28_give_overlap_to_later", IV + " SELECT id, start_us, least(stop_us, coalesce(lead(start_us) OVER (PARTITION BY series ORDER BY start_us, id), stop_us)) AS stop_us FROM iv")
def e28(spark, d):
    x = intervals(spark, d)
    return x.select("id", "start_us", F.least("stop_us", F.coalesce(F.lead("start_us").over(I.order()), F.col("stop_us"))).alias("stop_us"))


@query("e30_interlace_sentinels", IV + ", f AS (SELECT id, series, start_us, type, CASE WHEN start_us - lag(stop_us) OVER w > 3600000000 THEN 1 ELSE 0 END AS gap FROM iv WINDOW w AS (PARTITION BY series ORDER BY start_us, id)), b AS (SELECT series, start_us, id, 1 AS half, type FROM f UNION ALL SELECT series, start_us, id, 0, '|' FROM f WHERE gap = 1) SELECT series, row_number() OVER (PARTITION BY series ORDER BY start_us, id, half) AS place, type FROM b")
def e30(spark, d):
    x = intervals(spark, d).withColumn("gap", F.coalesce(F.col("start_us") - F.lag("stop_us").over(I.order()) > 3_600_000_000, F.lit(False)))
    mark, own = F.struct(F.lit(0).alias("half"), F.lit("|").alias("type")), F.struct(F.lit(1).alias("half"), F.col("type").alias("type"))
    marks = F.when(F.col("gap"), F.array(mark, own)).otherwise(F.array(own))
    x = x.select("series", "start_us", "id", F.inline(marks))
    return x.select("series", F.row_number().over(Window.partitionBy("series").orderBy("start_us", "id", "half")).alias("place"), "type")


@query("e31_local_windows", IV + ", w AS (SELECT id, series, unnest([start_us - 3000000, stop_us + 2000000]) AS start_us, unnest([start_us - 2000000, stop_us + 3000000]) AS stop_us FROM iv WHERE type = 'signup'), b AS (SELECT series, min(start_us) AS lo, max(stop_us) AS hi FROM iv GROUP BY series) SELECT id, greatest(start_us, lo) AS start_us, least(stop_us, hi) AS stop_us FROM w JOIN b USING (series) WHERE greatest(start_us, lo) < least(stop_us, hi)")
def e31(spark, d):
    x = intervals(spark, d)
    bounds = x.groupBy("series").agg(F.min("start_us").alias("lo"), F.max("stop_us").alias("hi"))
    two = F.array(F.struct((F.col("start_us") - 3_000_000).alias("s"), (F.col("start_us") - 2_000_000).alias("e")), F.struct((F.col("stop_us") + 2_000_000).alias("s"), (F.col("stop_us") + 3_000_000).alias("e")))
    w = x.where("type = 'signup'").select("id", "series", F.inline(two)).join(bounds, "series")
    return w.select("id", F.greatest("s", "lo").alias("start_us"), F.least("e", "hi").alias("stop_us")).where("start_us < stop_us")


@query("r01_drop_short", IV + " SELECT id FROM iv WHERE stop_us - start_us >= 10000000")
def r01(spark, d):
    return intervals(spark, d).where("stop_us - start_us >= 10000000").select("id")


@query("r03_most_frequent", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 2 ORDER BY n DESC, user_id LIMIT 20")
def r03(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "user_id").limit(20)


@query("r04_take_while_budget", IV + ", c AS (SELECT id, sum(stop_us - start_us) OVER (PARTITION BY series ORDER BY start_us, id) AS total FROM iv) SELECT id FROM c WHERE total < 3600000000 * 3")
def r04(spark, d):
    total = F.sum(F.col("stop_us") - F.col("start_us")).over(I.order())
    return intervals(spark, d).withColumn("total", total).where(F.col("total") < 3 * I.HOUR).select("id")


@query("r05_quota_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 10007, event_id) AS k FROM events) WHERE k <= 40")
def r05(spark, d):
    w = Window.partitionBy("event_type").orderBy((F.col("event_id") * 7919) % 10007, "event_id")
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 40").select("event_id")


@query("r09_dense_ids", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) AS type_id FROM events")
def r09(spark, d):
    e = table(spark, d, "events")
    ids = e.select("event_type").distinct().withColumn("type_id", F.row_number().over(Window.orderBy("event_type")))
    return e.join(F.broadcast(ids), "event_type").select("event_id", "type_id")


@query("r10_crosstab", "SELECT l_returnflag AS returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def r10(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("returnflag")).pivot("l_linestatus", ["F", "O"]).count()
    return x.fillna(0)


@query("s06_flat_labels_to_events", IV + ", r AS (SELECT series, start_us, row_number() OVER (PARTITION BY series ORDER BY start_us, id) AS k FROM iv), p AS (SELECT series, k, start_us, lead(start_us) OVER (PARTITION BY series ORDER BY k) AS stop_us FROM r) SELECT series, start_us, stop_us FROM p WHERE k % 2 = 1 AND stop_us IS NOT NULL")
def s06(spark, d):
    x = intervals(spark, d).withColumns({"k": F.row_number().over(I.order()), "next": F.lead("start_us").over(I.order())})
    return x.where("k % 2 = 1 AND next IS NOT NULL").select("series", "start_us", F.col("next").alias("stop_us"))


@query("s09_partition_filter", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN o_custkey - 3 ELSE o_custkey END AS age FROM orders WHERE year(o_orderdate) = 1995")
def s09(spark, d):
    o = table(spark, d, "orders").where(F.year("o_orderdate") == 1995)
    return o.select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, F.col("o_custkey") - 3).otherwise(F.col("o_custkey")).alias("age"))


@query("s13_pack_clips", IV + ", c AS (SELECT id, series, sum(stop_us - start_us) OVER (PARTITION BY series ORDER BY start_us, id) - (stop_us - start_us) AS before FROM iv) SELECT id, before // 3600000000 AS pack FROM c")
def s13(spark, d):
    size = F.col("stop_us") - F.col("start_us")
    return intervals(spark, d).select("id", F.floor((F.sum(size).over(I.order()) - size) / I.HOUR).alias("pack"))


@query("s19_unique_lookup", "SELECT s_suppkey, CASE WHEN n = 1 THEN name END AS nation FROM supplier LEFT JOIN (SELECT n_nationkey, count(*) AS n, min(n_name) AS name FROM nation GROUP BY 1) ON s_nationkey = n_nationkey")
def s19(spark, d):
    n = table(spark, d, "nation").groupBy("n_nationkey").agg(F.count("*").alias("n"), F.min("n_name").alias("name"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select("s_suppkey", F.when(F.col("n") == 1, F.col("name")).alias("nation"))
