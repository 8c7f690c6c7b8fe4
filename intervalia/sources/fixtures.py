"""The driver's tables as intervals, points, series, vectors and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a key where its scan has fewer partitions than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to as many partitions as shuffles have; small data that cost much work are then not put together into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def intervals(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """id, series, type, start_us, stop_us; value is a length in minutes. Times are whole microseconds."""
    e = table(spark, sf_dir, "events")
    if types:
        e = e.where(F.col("event_type").isin(*types))
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("series"), F.col("event_type").alias("type"), start.alias("start_us"), (start + F.round(F.col("value") * 60e6).cast("long")).alias("stop_us"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t_us of the view events, as a point process."""
    return intervals(spark, sf_dir, "view").select("series", F.col("start_us").alias("t_us"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v array<double>, label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, k (1-based frame), x: vectors as sampled series."""
    v = vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("v").alias("k", "x"))
    return v.withColumn("k", F.col("k") + 1)


#: Samples a second of the signals.
FS = 1000.0


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, x: runs of eight vectors as one signal of 512 samples; the last may be shorter."""
    v = vectors(spark, sf_dir).where("v IS NOT NULL").withColumn("sid", F.floor(F.col("vec_id") / 8))
    return v.groupBy("sid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"])).alias("x"))


#: The same in SQL.
SQL = {
    "iv": "iv AS (SELECT event_id AS id, user_id AS series, event_type AS type, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 60e6) AS BIGINT) AS stop_us FROM events)",
    "pt": "pt AS (SELECT user_id AS series, epoch_us(ts) AS t_us FROM events WHERE event_type = 'view')",
    "fr": "fr AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)",
    "ve": "ve AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
