"""Structured Streaming twins: bouts, counts and state spells of interval streams, with watermarks.

The streams have series, type, start and stop (timestamps). Rows later than the watermark are dropped by Spark; all
others give what the batch operators give once the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bouts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """series, start, stop and n of runs of events whose starts are less than a gap apart."""
    s = events.withWatermark("start", late).groupBy("series", F.session_window("start", gap).alias("w"))
    out = s.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"))
    return out.select("series", "start", "stop", "n")


def counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """series, type, start of the window, n and seconds of the events that begin in windows of a width."""
    e = events.withWatermark("start", late)
    out = e.groupBy("series", "type", F.window("start", width).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("stop").cast("double") - F.col("start").cast("double")).alias("seconds"))
    return out.select("series", "type", F.col("w.start").alias("start"), "n", "seconds")


def overlapping(left: DataFrame, right: DataFrame, longest: str, late: str) -> DataFrame:
    """Pairs of events of two streams of one series that overlap; no event is longer than `longest`, which bounds the state."""
    a = left.withWatermark("start", late).select(F.col("series").alias("a_series"), F.col("start").alias("a_start"), F.col("stop").alias("a_stop"))
    b = right.withWatermark("start", late).select(F.col("series").alias("b_series"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    span = F.expr(f"INTERVAL {longest}")
    near = (F.col("b_start") >= F.col("a_start") - span) & (F.col("b_start") <= F.col("a_start") + span)
    meets = (F.col("a_series") == F.col("b_series")) & near & (F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop"))
    return a.join(b, meets).select(F.col("a_series").alias("series"), "a_start", "a_stop", "b_start", "b_stop")


def transitions(events: DataFrame) -> DataFrame:
    """series, before, after and n: changes of type from one event to the next, as they arrive, kept by series.

    The state of a series is its last type, so it does not grow with the stream. Events of a series are taken in
    the order of their starts within a trigger.
    """

    def each(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(frames)).sort_values("start", kind="stable")
        last = state.get[0] if state.exists else None
        types = ([] if last is None else [last]) + got["type"].tolist()
        state.update((types[-1],))
        n = pd.DataFrame({"before": types[:-1], "after": types[1:]}).groupby(["before", "after"]).size().reset_index(name="n")
        yield n.assign(series=key[0])[["series", "before", "after", "n"]]

    return events.select("series", "type", "start").groupBy("series").applyInPandasWithState(each, "series long, before string, after string, n long", "type string", "append", "NoTimeout")
