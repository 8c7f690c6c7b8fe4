"""Queries of file sources, table functions and reductions in SQL (S, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervalia.functions import reductions
from intervalia.plans.registry import query
from intervalia.sources import files
from intervalia.sources.fixtures import FS, intervals, signals, spread, table, with_
from intervalia.sources.shared import shared_folder


def wav_folder(spark, d) -> str:
    """The signals as files of a new folder, one each."""
    files.register(spark)
    path = shared_folder(spark, "wav")
    x = signals(spark, d).select(F.format_string("%06d.wav", "sid").alias("file"), F.lit(int(FS)).alias("rate"), "x")
    x.write.format("wav").mode("append").save(path)
    return path


FILES = """WITH fr AS (SELECT vec_id // 8 AS sid, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT sid, least(greatest(CAST(round_even(x * 32768, 0) AS BIGINT), -32768), 32767) AS q FROM fr)
"""


@query("s22_wav_files", FILES + f"SELECT printf('%06d.wav', sid) AS file, {int(FS)} AS rate, count(*) AS frames, sum(q)::BIGINT AS total, max(abs(q)) AS peak FROM q GROUP BY sid")
def s22(spark, d):
    """Length, sum and peak of signals in a folder of WAV files, read in rows of 128 samples and parts of 1,000 bytes."""
    x = spark.read.format("wav").option("chunk", 128).option("partbytes", 1000).load(wav_folder(spark, d))
    q = F.transform("x", lambda v: F.rint(v * 32768).cast("long"))
    sums = x.select("file", "rate", "frames", F.aggregate(q, F.lit(0).cast("long"), lambda a, v: a + v).alias("s"), F.array_max(F.transform(q, F.abs)).alias("p"))
    return sums.groupBy("file", "rate", "frames").agg(F.sum("s").alias("total"), F.max("p").alias("peak"))


@query("s23_wav_clips", FILES + ", k AS (SELECT vec_id // 8 AS sid, (vec_id % 8) * 64 AS begin, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL) SELECT printf('%06d.wav', sid) AS file, count(*) AS n FROM k WHERE sid IN (3, 5) AND begin + j BETWEEN 128 AND 255 GROUP BY sid")
def s23(spark, d):
    """The second clip of 128 samples of two files: the source opens those two and reads that range alone."""
    x = spark.read.format("wav").option("chunk", 128).load(wav_folder(spark, d))
    x = x.where(F.col("file").isin("000003.wav", "000005.wav") & (F.col("channel") == 0) & (F.col("start") >= 128) & (F.col("start") < 256))
    return x.select("file", F.size("x").cast("long").alias("n"))


@query("s24_recording_files", "SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS nation, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier")
def s24(spark, d):
    """Suppliers written as delimited texts that name their columns after a percent sign, and read as recordings."""
    files.register(spark)
    path = shared_folder(spark, "recording")
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("%<id>"), F.col("s_nationkey").alias("<nation>"), F.col("s_acctbal").alias("<balance>"))
    x.write.option("sep", " ").option("header", "true").csv(path)
    long = spark.read.format("recording").option("suffix", ".csv").load(path)
    wide = long.groupBy("file", "row").pivot("field", ["id", "nation", "balance"]).agg(F.first("number"))
    return wide.select(F.col("id").cast("long").alias("id"), "nation", "balance")


@query(
    "u01_split_overlapping",
    with_("iv") + ", p AS (SELECT id, start_us, stop_us, unnest(range(4)) AS k FROM iv) SELECT id, CAST(k + 1 AS INTEGER) AS piece, start_us + k * (stop_us - start_us) / (4 - 3 * 0.5) * 0.5 AS start, start_us + k * (stop_us - start_us) / (4 - 3 * 0.5) * 0.5 + (stop_us - start_us) / (4 - 3 * 0.5) AS stop FROM p",
)
def u01(spark, d):
    """Intervals in four pieces that overlap by half, by a table function in SQL."""
    reductions.register(spark)
    return spark.sql("SELECT id, p.piece, p.start, p.stop FROM {iv} AS iv, LATERAL split_overlapping(iv.start_us, iv.stop_us, 4, 0.5D) AS p", iv=spread(intervals(spark, d), "id"))


@query(
    "u02_grams",
    "WITH g AS (SELECT user_id, ts, event_id, event_type || ' ' || lead(event_type) OVER w AS gram FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)) SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram",
)
def u02(spark, d):
    """Pairs of neighbouring types within a day of a user, by a table function in SQL."""
    reductions.register(spark)
    e = table(spark, d, "events")
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"]).alias("labels"))
    return spark.sql("SELECT p.gram, count(*) AS n FROM {days} AS d, LATERAL grams(d.labels, 2) AS p GROUP BY p.gram", days=days)


@query("u03_grouped_functions", "SELECT user_id, avg(value) ^ 2 / avg(value * value) AS activity, mad(value) AS deviation FROM events GROUP BY user_id")
def u03(spark, d):
    """Activity fraction and median deviation of the values of each user, by grouped functions in SQL."""
    reductions.register(spark)
    return spark.sql("SELECT user_id, activity_fraction(value) AS activity, median_deviation(value) AS deviation FROM {e} GROUP BY user_id", e=table(spark, d, "events"))


@query(
    "u04_summed_reduction",
    "WITH m AS (SELECT l_linenumber, count(*) AS n, avg(x) AS m1, avg(x ^ 2) AS m2, avg(x ^ 3) AS m3, avg(x ^ 4) AS m4 FROM (SELECT l_linenumber, CAST(l_quantity AS DOUBLE) AS x FROM lineitem) GROUP BY ALL), v AS (SELECT *, m2 - m1 ^ 2 AS v FROM m) SELECT l_linenumber, CAST(n AS DOUBLE) AS n, m1 AS mean, sqrt(v) AS sd, (m3 - 3 * m1 * m2 + 2 * m1 ^ 3) / v ^ 1.5 AS skew, (m4 - 4 * m1 * m3 + 6 * m1 ^ 2 * m2 - 3 * m1 ^ 4) / v ^ 2 AS kurtosis FROM v",
)
def u04(spark, d):
    """Shape of the quantities by line number, by a reduction whose parts add up."""
    return reductions.reduced(table(spark, d, "lineitem"), "l_linenumber", "l_quantity", reductions.SHAPE)
