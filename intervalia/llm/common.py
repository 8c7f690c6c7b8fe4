"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Java and Python character class of a word; the separators are space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: What modules remember in a Python worker from one task to the next.
CACHES: list[dict] = []


def forget() -> None:
    """Drops what other operators left in this worker, which tasks of all operators share one after the other.

    Memory that is free already is given back to the system, where its C library can.
    """
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir.

    Only where it is unset and everything runs in one process, as in tests, a folder of this machine takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="intervalia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at, out._rows = path, seen.get["n"]
    return out


def rows_of(df: DataFrame) -> int:
    """The number of rows; what saved() wrote was counted as it was written."""
    return df._rows if hasattr(df, "_rows") else df.count()


def dropped(*frames: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_saved_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(column: str | Column = "text") -> Column:
    """Native array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(text_of(column), GAP), lambda w: w != "")


def n_words(column: str | Column = "text") -> Column:
    """Native number of words of a text."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")
