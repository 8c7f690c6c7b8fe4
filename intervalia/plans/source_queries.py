"""Queries on sources, catalogues and reports (S), and on feature tables (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from intervalia.operators import intervals as I
from intervalia.plans.registry import query
from intervalia.sources.fixtures import frames, intervals, table, with_

FR, IV = with_("fr"), with_("iv")
R = F.round


@query("s02_concatenate_clips", IV + " SELECT id, sum(stop_us - start_us) OVER w - (stop_us - start_us) + (row_number() OVER w - 1) * 500000 AS offset_us FROM iv WINDOW w AS (PARTITION BY series ORDER BY start_us, id ROWS UNBOUNDED PRECEDING)")
def s02(spark, d):
    """Offset of each clip in its series, with half a second of silence between clips."""
    w = Window.partitionBy("series").orderBy("start_us", "id")
    size = F.col("stop_us") - F.col("start_us")
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size
    return intervals(spark, d).select("id", (before + (F.row_number().over(w) - 1) * 500000).alias("offset_us"))


@query("s03_metadata_only", "SELECT doc_id, lang, source, n_chars FROM documents")
def s03(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("s04_clip_samples", FR + " SELECT vec_id, count(*) AS n, round(sum(x), 6) AS total FROM fr WHERE k BETWEEN vec_id % 60 + 1 AND least(64, vec_id % 60 + 16) GROUP BY vec_id")
def s04(spark, d):
    """Samples of one clip of each series, clamped at its end."""
    v = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", (F.col("vec_id") % 60 + 1).cast("int"), F.lit(16)).alias("c"))
    return v.select("vec_id", F.size("c").cast("long").alias("n"), R(F.aggregate("c", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("s05_delimited_text", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s05(spark, d):
    """Rows of delimited text, read back by column with inferred types."""
    line = table(spark, d, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string")).alias("line"))
    row = line.select(F.from_csv("line", "s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE", {"sep": "\t", "comment": "%"}).alias("r"))
    return row.select("r.*")


@query("s07_level_channel", IV + ", c AS (SELECT series, t, up FROM (SELECT series, start_us AS t, true AS up, id FROM iv WHERE type = 'signup' UNION ALL SELECT series, start_us, false, id FROM iv WHERE type = 'click')), n AS (SELECT series, t, up, lead(t) OVER w AS t2, lead(up) OVER w AS up2 FROM c WINDOW w AS (PARTITION BY series ORDER BY t, up)) SELECT series, t AS start_us, t2 AS stop_us FROM n WHERE up AND NOT up2")
def s07(spark, d):
    """Events from a level channel: a rise that a fall follows."""
    c = intervals(spark, d, "signup", "click").select("series", F.col("start_us").alias("t"), (F.col("type") == "signup").alias("up"))
    w = Window.partitionBy("series").orderBy("t", "up")
    n = c.withColumns({"t2": F.lead("t").over(w), "up2": F.lead("up").over(w)})
    return n.where("up AND NOT up2").select("series", F.col("t").alias("start_us"), F.col("t2").alias("stop_us"))


@query("s08_unit_times", "WITH t AS (SELECT user_id, event_id, epoch_us(ts) AS t_us, CAST(json_extract(props, '$.k') AS BIGINT) AS unit FROM events) SELECT unit, user_id AS series, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM t GROUP BY 1, 2")
def s08(spark, d):
    """Times of each unit by an index that comes with them."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.get_json_object("props", "$.k").cast("long").alias("unit"))
    return e.groupBy("unit", F.col("user_id").alias("series")).agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("s10_label_variant", "SELECT d.doc_id, CASE WHEN toxic = 1 THEN -1 ELSE coalesce(quality, 9) END AS label FROM documents d LEFT JOIN labels USING (doc_id)")
def s10(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", F.when(F.col("toxic") == 1, -1).otherwise(F.coalesce("quality", F.lit(9))).alias("label"))


@query("s11_latest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def s11(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("s12_sampling_rate", "WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT user_id, round(1e6 / avg(g), 9) AS rate FROM g GROUP BY 1 HAVING avg(g) > 0")
def s12(spark, d):
    """Rate as the inverse of the mean interval."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    g = table(spark, d, "events").select("user_id", (t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("g"))
    return g.groupBy("user_id").agg(F.avg("g").alias("m")).where("m > 0").select("user_id", R(1e6 / F.col("m"), 9).alias("rate"))


@query("s14_catalogue", "SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (WHERE regexp_matches(p_name, '[0-9]*[02468]$')) AS matched, string_agg(CASE WHEN k NOT IN (SELECT l_partkey FROM lineitem) THEN k::VARCHAR END, ',' ORDER BY k) AS unclaimed FROM (SELECT *, p_partkey AS k FROM part) GROUP BY 1")
def s14(spark, d):
    """Files by group: how many names match a pattern, and those that nothing claims."""
    used = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("used", F.lit(1))
    p = table(spark, d, "part").join(used, "p_partkey", "left")
    free = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("used").isNull(), F.col("p_partkey")))), lambda x: x.cast("string")), ",")
    return p.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.count_if(F.col("p_name").rlike("[0-9]*[02468]$")).alias("matched"), F.nullif(free, F.lit("")).alias("unclaimed"))


@query("s15_find_in_manifest", "SELECT event_type AS name, max(event_id) AS last, arg_min(event_id, (length(props), event_id)) AS shortest FROM events WHERE event_type IN ('click', 'signup', 'absent') GROUP BY 1")
def s15(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "signup", "absent"))
    return e.groupBy(F.col("event_type").alias("name")).agg(F.max("event_id").alias("last"), F.min_by("event_id", F.struct(F.length("props"), "event_id")).alias("shortest"))


@query("s16_load_from_manifest", "SELECT event_id, user_id, value FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)")
def s16(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("event_id")
    return e.join(last, "event_id", "left_semi").select("event_id", "user_id", "value")


@query("s17_payload_and_metadata", "SELECT doc_id, 'meta' AS part, coalesce(lang, '') || '|' || coalesce(source, '') AS body FROM documents UNION ALL SELECT doc_id, 'payload', text FROM documents")
def s17(spark, d):
    meta = F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("source", F.lit("")))
    x = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit("meta").alias("part"), meta.alias("body")), F.struct(F.lit("payload").alias("part"), F.col("text").alias("body")))).alias("r"))
    return x.select("doc_id", "r.part", "r.body")


@query("s18_replace_variable", "SELECT c_custkey AS id, greatest(c_acctbal, 0) AS balance FROM customer")
def s18(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return c.withColumnRenamed("c_custkey", "id").select("id", F.greatest("c_acctbal", F.lit(0.0)).alias("balance"))


@query("s20_collapse_keys", "WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem) SELECT l_orderkey, count(*) FILTER (WHERE p IS NULL OR p <> f) AS runs, bool_or(f = 'R') AS flagged FROM k GROUP BY 1")
def s20(spark, d):
    """Runs of equal keys count once; a group is flagged if a unit in it is."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    k = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("f"), F.lag("l_returnflag").over(w).alias("p"))
    return k.groupBy("l_orderkey").agg(F.count_if(F.col("p").isNull() | (F.col("p") != F.col("f"))).alias("runs"), F.bool_or(F.col("f") == "R").alias("flagged"))


@query("s21_day_report", IV + " SELECT start_us // 86400000000 AS day, series, count(*) AS n, round(sum(stop_us - start_us) / 1e6, 3) AS seconds, count(*) FILTER (WHERE type <> 'view') AS labelled, round(count(*) FILTER (WHERE type = 'purchase') / count(*), 6) AS share FROM iv GROUP BY 1, 2")
def s21(spark, d):
    iv = intervals(spark, d).withColumn("day", F.floor(F.col("start_us") / 86400000000))
    named = lambda c: F.count_if(c)
    return iv.groupBy("day", "series").agg(F.count("*").alias("n"), R(F.sum(F.col("stop_us") - F.col("start_us")) / 1e6, 3).alias("seconds"), named(F.col("type") != "view").alias("labelled"), R(named(F.col("type") == "purchase") / F.count("*"), 6).alias("share"))


@query("a04_numeric_columns", "SELECT 'c_acctbal' AS name, 'double' AS kind UNION ALL SELECT 'c_custkey', 'bigint' UNION ALL SELECT 'c_nationkey', 'int'")
def a04(spark, d):
    """Columns that are numbers, from the schema alone."""
    kinds = [(n, k) for n, k in table(spark, d, "customer").dtypes if k in ("double", "float", "int", "bigint", "smallint")]
    return spark.createDataFrame(kinds, "name string, kind string")


@query("a08_regroup_features", FR + ", g AS (SELECT vec_id, 'root' || CAST((k - 1) // 16 AS VARCHAR) AS root, x FROM fr) SELECT vec_id, round(avg(x) FILTER (WHERE root = 'root0'), 6) AS root0, round(avg(x) FILTER (WHERE root = 'root1'), 6) AS root1, round(avg(x) FILTER (WHERE root = 'root2'), 6) AS root2, round(avg(x) FILTER (WHERE root = 'root3'), 6) AS root3 FROM g GROUP BY vec_id")
def a08(spark, d):
    """Features named root_number, averaged by root."""
    x = frames(spark, d).withColumn("name", F.concat(F.lit("root"), F.floor((F.col("k") - 1) / 16), F.lit("_"), F.col("k"))).withColumn("root", F.substring_index("name", "_", 1))
    return x.groupBy("vec_id").pivot("root", [f"root{k}" for k in range(4)]).agg(R(F.avg("x"), 6))


@query("a11_motif_variation", IV + ", k AS (SELECT series, type, stop_us - start_us AS len, row_number() OVER (PARTITION BY series, type ORDER BY start_us, id) AS a, row_number() OVER (PARTITION BY series, type ORDER BY start_us DESC, id DESC) AS z, count(*) OVER (PARTITION BY series, type) AS n FROM iv) SELECT series, type, round(stddev_samp(len) / 1e6, 6) AS spread, round(stddev_samp(len) / nullif(avg(len), 0), 6) AS cv, round(avg(len) FILTER (WHERE z <= 2) / nullif(avg(len) FILTER (WHERE a <= 2), 0), 6) AS ratio FROM k WHERE n >= 4 GROUP BY series, type")
def a11(spark, d):
    """Spread of the lengths of a series' motifs of a type, and the last two against the first two, where there are four."""
    by = Window.partitionBy("series", "type")
    size = F.col("stop_us") - F.col("start_us")
    k = intervals(spark, d).select("series", "type", size.alias("len"), F.row_number().over(by.orderBy("start_us", "id")).alias("a"), F.row_number().over(by.orderBy(F.desc("start_us"), F.desc("id"))).alias("z"), F.count("*").over(by).alias("n")).where("n >= 4")
    zero = lambda c: F.nullif(c, F.lit(0.0))
    return k.groupBy("series", "type").agg(R(F.stddev_samp("len") / 1e6, 6).alias("spread"), R(F.stddev_samp("len") / zero(F.avg("len")), 6).alias("cv"), R(F.avg(F.when(F.col("z") <= 2, F.col("len"))) / zero(F.avg(F.when(F.col("a") <= 2, F.col("len")))), 6).alias("ratio"))


@query("a18_feature_count_guard", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 3 * count(DISTINCT event_type)")
def a18(spark, d):
    """Groups with at least three rows for each feature."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("k"))
    return n.where("n >= 3 * k").select("user_id", "n")


@query("k11_equal_neighbours", IV + ", g AS (SELECT id, stop_us - start_us AS len, lead(stop_us - start_us) OVER (PARTITION BY series ORDER BY start_us, id) AS next FROM iv) SELECT id FROM g WHERE abs(next - len) <= 10000000 AND len > 1000000")
def k11(spark, d):
    """Candidates for calls: intervals that are followed by one of about their length."""
    size = F.col("stop_us") - F.col("start_us")
    g = intervals(spark, d).select("id", size.alias("len"), F.lead(size).over(I.order("series", "id")).alias("next"))
    return g.where("abs(next - len) <= 10000000 AND len > 1000000").select("id")
