"""Maximal repeats of any length in the sequences of many series: the inner nodes of their common suffix tree that are left-diverse.

A repeat is maximal if its occurrences have neither all the same symbol before them nor all the same after them; the start and the end of a
sequence are like no other symbol. Places are dealt by the symbols that they begin with. A class of few places is sorted by the
next symbols in one task, where intervals of common prefixes are the nodes of the tree; places that agree in all symbols that were looked at go
on to the next round with twice as many. A class of many places is divided by Spark, a few symbols a round, and never meets in one task.
Rounds are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervalia.operators.smoothing import ranked
from intervalia.sources.shared import written

#: Places of a class that one task sorts, symbols that a larger class is divided by, and symbols that a smaller one is first sorted by.
MOST, STEP, FIRST = 20_000, 6, 32


def placed(rows: DataFrame, stretch: float) -> DataFrame:
    """series, r (from 0) and c of rows (series, id, x, c) in order of x, then id; c is one character."""
    at = ranked(rows.select("series", "id", "x", F.lit(0.0).alias("y")), stretch)
    return at.select("series", "id", "x", "r").join(rows.select("series", "id", "x", "c"), ["series", "id", "x"]).select("series", "r", "c")


def _chunks(symbols: DataFrame, size: int) -> DataFrame:
    """series, b and s: the symbols of places b * size up to (b + 2) * size."""
    own = symbols.groupBy("series", F.floor(F.col("r") / size).alias("b")).agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("r", "c"))), lambda t: t["c"])).alias("s"))
    after = own.select("series", (F.col("b") - 1).alias("b"), F.col("s").alias("t"))
    return own.join(after, ["series", "b"], "left").select("series", "b", F.concat("s", F.coalesce("t", F.lit(""))).alias("s"))


def _texts(places: DataFrame, symbols: DataFrame, size: int, at: Column) -> DataFrame:
    """places (series, ...) with t, up to size symbols from place at on."""
    x = places.withColumn("_at", at).withColumn("b", F.floor(F.col("_at") / size))
    met = x.join(_chunks(symbols, size), ["series", "b"], "left")
    return met.withColumn("t", F.coalesce(F.substr("s", (F.col("_at") - F.col("b") * size + 1).cast("int"), F.lit(size)), F.lit(""))).drop("_at", "b", "s")


ROUND = "node boolean, cls string, depth long, series long, r long, lead string, n long"


def sorted_class(own: pd.DataFrame, size: int) -> pd.DataFrame:
    """Nodes of a class, and the places that go on; t are the next symbols, up to size of them, lead the one before or null."""
    own = own.sort_values(["t", "series", "r"], kind="stable")
    t, n = own["t"].tolist(), len(own)
    common = [0] * n
    for k in range(1, n):
        a, b = t[k - 1], t[k]
        lo, hi = 0, min(len(a), len(b))
        # the length of the common prefix, by halving
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if a[:mid] == b[:mid]:
                lo = mid
            else:
                hi = mid - 1
        common[k] = lo
    lead = own["lead"].to_numpy(object)
    ends = np.concatenate(([0], np.cumsum([v is None for v in lead])))
    changes = np.concatenate(([0], np.cumsum([lead[k] != lead[k - 1] for k in range(1, n)], dtype=int)))
    key, depth = own["cls"].iloc[0], int(own["depth"].iloc[0])
    series, r = own["series"].to_numpy(), own["r"].to_numpy()
    rows = []

    def close(length: int, a: int, b: int) -> None:
        """The interval of places a up to b with a common prefix."""
        if length == size:
            rows.extend((False, f"{key}\0{a}", depth + size, series[k], r[k], lead[k], b - a) for k in range(a, b))
        elif ends[b] > ends[a] or changes[b - 1] > changes[a]:
            first = min(range(a, b), key=lambda k: (series[k], r[k]))
            rows.append((True, None, depth + length, series[first], r[first], None, b - a))

    open_: list[tuple[int, int]] = []
    for k in range(1, n + 1):
        length, begin = common[k] if k < n else -1, k - 1
        while open_ and open_[-1][0] > length:
            own_length, begin = open_.pop()
            close(own_length, begin, k)
        if k < n and (not open_ or open_[-1][0] < length):
            open_.append((length, begin))
    return pd.DataFrame(rows, columns=["node", "cls", "depth", "series", "r", "lead", "n"])


def _sorted_round(places: DataFrame, symbols: DataFrame, size: int) -> DataFrame:
    x = _texts(places, symbols, size, F.col("r") + F.col("depth"))
    return x.groupBy("cls", "depth").applyInPandas(lambda own: sorted_class(own, size), ROUND)


def _divided_round(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same for classes of many places: nodes of the next STEP lengths by grouping, and the places that go on."""
    x = _texts(places, symbols, STEP + 1, F.col("r") + F.col("depth"))
    lengths = F.explode(F.sequence(F.lit(0), F.least(F.length("t"), F.lit(STEP - 1))))
    each = x.withColumn("l", lengths).withColumn("after", F.when(F.length("t") > F.col("l"), F.substr("t", F.col("l") + 1, F.lit(1))))
    nodes = each.groupBy("cls", "depth", "l", F.substr("t", F.lit(1), F.col("l")).alias("p")).agg(
        F.count("*").alias("n"), F.min(F.struct("series", "r")).alias("first"), *[(F.count_if(F.col(c).isNull()) > 0).alias(f"{c}_end") for c in ("lead", "after")], *[(F.min(c) < F.max(c)).alias(f"{c}_two") for c in ("lead", "after")]
    )
    nodes = nodes.where("n > 1 AND (lead_end OR lead_two) AND (after_end OR after_two)")
    nodes = nodes.select(F.lit(True).alias("node"), F.lit(None).cast("string").alias("cls"), (F.col("depth") + F.col("l")).alias("depth"), "first.series", "first.r", F.lit(None).cast("string").alias("lead"), "n")
    on = x.where(F.length("t") >= STEP).select(F.lit(False).alias("node"), F.concat("cls", F.substr("t", F.lit(1), F.lit(STEP))).alias("cls"), (F.col("depth") + STEP).alias("depth"), "series", "r", "lead")
    sizes = on.groupBy("cls", "depth").agg(F.count("*").alias("n")).where("n > 1")
    return nodes.unionByName(on.join(sizes, ["cls", "depth"]).select(*nodes.columns))


def maximal_repeats(symbols: DataFrame, least: int = 1, most: int = MOST, first: int = FIRST) -> DataFrame:
    """motif, length and n (occurrences) of the maximal repeats of at least `least` symbols in sequences (series, r, c)."""
    symbols = written(symbols.select(F.col("series").cast("long").alias("series"), F.col("r").cast("long").alias("r"), "c"), "symbols")
    before = symbols.select("series", (F.col("r") + 1).alias("r"), F.col("c").alias("lead"))
    x = _texts(symbols.join(before, ["series", "r"], "left"), symbols, max(least, 1), F.col("r"))
    x = x.where(F.length("t") == least) if least else x
    classes = x.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    places = x.join(classes, "t").select(F.col("t").alias("cls"), F.lit(max(least, 1)).cast("long").alias("depth"), "series", "r", "lead", "n")
    found, size = [], first
    places = written(places, "repeats")
    while not places.isEmpty():
        few = _sorted_round(places.where(F.col("n") <= most), symbols, size)
        done = written(few.unionByName(_divided_round(places.where(F.col("n") > most), symbols)), "repeats")
        found.append(done.where("node").select("depth", "series", "r", "n"))
        places, size = done.where("NOT node").drop("node"), size * 2
    spark = symbols.sparkSession
    nodes = spark.createDataFrame([], "depth long, series long, r long, n long")
    for f in found:
        nodes = nodes.unionByName(f)
    return _spelled(nodes, symbols).select("motif", F.col("depth").alias("length"), "n")


def _spelled(nodes: DataFrame, symbols: DataFrame, size: int = 64) -> DataFrame:
    """nodes (series, r, depth) with motif, their symbols, put together of chunks."""
    own = symbols.groupBy("series", F.floor(F.col("r") / size).alias("b")).agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("r", "c"))), lambda t: t["c"])).alias("s"))
    x = nodes.withColumn("b", F.explode(F.sequence(F.floor(F.col("r") / size), F.floor((F.col("r") + F.col("depth") - 1) / size))))
    parts = x.join(own, ["series", "b"]).groupBy("series", "r", "depth", "n").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("b", "s"))), lambda t: t["s"])).alias("s"))
    return parts.withColumn("motif", F.substr("s", (F.col("r") % size + 1).cast("int"), F.col("depth").cast("int")))


def occurrences(motif: str, symbols: DataFrame) -> DataFrame:
    """series and r of the places of a motif, overlaps included, in chunks of symbols that hold it."""
    size = max(len(motif), 64)
    places = symbols.select(F.col("series").cast("long").alias("series"), F.col("r").cast("long").alias("r"))
    return _texts(places, symbols, size, F.col("r")).where(F.col("t").startswith(motif)).select("series", "r")
