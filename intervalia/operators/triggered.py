"""Averages about triggers, and evoked means of trials with bootstrap errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.operators.dsp import local_line


def triggered_gram(samples: DataFrame, triggers: DataFrame, reach: int, width: int, step: int) -> DataFrame:
    """series, start, lag, n and mean of samples (series, k, x) about triggers (series, k), by windows of triggers.

    A window holds the triggers of width frames from start on, starts are step apart and from 0. Samples go to the chunks beside them, so the join is by series
    and chunk.
    """
    size = max(2 * reach, 1)
    near = F.explode(F.array(*[F.floor(F.col("k") / size) + c for c in (-1, 0, 1)]))
    x = samples.select("series", F.col("k").alias("at"), "x", near.alias("c"))
    t = triggers.select("series", F.col("k").alias("k0"), F.floor(F.col("k") / size).alias("c"))
    met = t.join(x, ["series", "c"]).withColumn("lag", F.col("at") - F.col("k0")).where(F.abs("lag") <= reach)
    # sums by trigger place first: each belongs to width / step windows
    sums = met.groupBy("series", "k0", "lag").agg(F.count("x").alias("n"), F.sum("x").alias("s"))
    last = F.floor(F.col("k0") / step)
    first = F.greatest(F.floor((F.col("k0") - width) / step) + 1, F.lit(0))
    start = F.explode(F.transform(F.sequence(first, last), lambda w: w * step))
    return sums.select("series", start.alias("start"), "lag", "n", "s").groupBy("series", "start", "lag").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))


def evoked(trials: DataFrame, draws: int = 20, smooth: int = 0, seed: int = 1) -> DataFrame:
    """key, k, n, mean, sem and error of trials (key, id, v array): error is the deviation of the means of draws of trials.

    A draw takes a trial as often as a Poisson number of mean 1 from its id says, so tasks add up sums. smooth is the length
    of the running lines that smooth the mean and each draw, none below 5. Trials of a key are of one length; one of another is left out.
    """

    def part(batches):
        for b in batches:
            for key, own in b.groupby("key"):
                v = np.stack(own["v"].to_numpy()).astype(float)
                times = np.column_stack([np.ones(len(v)), [np.random.default_rng([seed, int(i) & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, draws) for i in own["id"]]])
                rows = np.arange(draws + 1)
                yield pd.DataFrame({"key": key, "draw": rows, "n": times.sum(0), "s": list(times.T @ v), "q": list((times * (rows == 0)).T @ (v * v))})

    def finish(own):
        own = own[own["n"] > 0].sort_values("draw")
        n = own["n"].to_numpy()
        means = np.stack(own["s"].to_numpy()) / n[:, None]
        q = np.asarray(own["q"].iloc[0], float)
        sem = np.sqrt(np.maximum(q - n[0] * means[0] ** 2, 0) / max(n[0] - 1, 1) / n[0])
        if smooth > 4:
            means = np.stack([local_line(m, smooth, smooth // 2) for m in means])
        error = means[1:].std(0) if len(means) > 1 and n[0] > 3 else np.full(means.shape[1], np.nan)
        return pd.DataFrame({"key": own["key"].iloc[0], "k": np.arange(1, means.shape[1] + 1), "n": int(n[0]), "mean": means[0], "sem": sem, "error": error})

    usual = trials.where("v IS NOT NULL").groupBy("key", F.size("v").alias("z")).agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "z"))["z"].alias("z"))
    x = trials.join(usual, "key").where(F.size("v") == F.col("z")).select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), "v")
    sums = x.mapInPandas(part, "key long, draw int, n double, s array<double>, q array<double>").select("key", "draw", "n", F.posexplode(F.arrays_zip("s", "q")).alias("k", "z"))
    sums = sums.groupBy("key", "draw", "k").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
    ordered = F.sort_array(F.collect_list(F.struct("k", "s", "q")))
    drawn = sums.groupBy("key", "draw").agg(F.first("n").alias("n"), ordered.alias("z")).select("key", "draw", "n", F.col("z.s").alias("s"), F.col("z.q").alias("q"))
    # as many rows of a key as draws
    return drawn.groupBy("key").applyInPandas(finish, "key long, k int, n long, mean double, sem double, error double")


def event_related(triggers: DataFrame, points: DataFrame, bin_us: int, bins: int) -> DataFrame:
    """key, bin, n, mean, sem and sign of the counts of points about triggers, less what the rate of the series gives.

    triggers are key, series, id and t_us; points series and t_us; bins lie from -bins to bins - 1 about a trigger. The rate of a series is the number of its
    points over the time from the first trigger or point of any series to the last. Triggers without a point in a bin count 0 there. sign is 1 or -1 where
    the mean is above or below 0 by more than the errors that 95 % of t allow, else 0.
    """
    from intervalia.operators.rangejoin import points_in
    from intervalia.operators.spectra import t_quantile

    # one row
    span = triggers.select("t_us").union(points.select("t_us")).agg((F.max("t_us") - F.min("t_us")).alias("span"))
    rate = points.groupBy("series").agg(F.count("*").alias("c")).crossJoin(F.broadcast(span)).select("series", F.when(F.col("span") > 0, F.col("c") * bin_us / F.col("span")).otherwise(0.0).alias("b"))
    t = triggers.join(rate, "series", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    whole = t.groupBy("key").agg(F.count("*").alias("n"), F.sum("b").alias("sb"), F.sum(F.col("b") * F.col("b")).alias("qb"))
    spans = t.select("key", "series", "id", "b", F.col("t_us").alias("at"), (F.col("t_us") - bins * bin_us).alias("start_us"), (F.col("t_us") + bins * bin_us - 1).alias("stop_us"))
    met = points_in(spans, points.select("series", "t_us"), 2 * bins * bin_us)
    counts = met.groupBy("key", "series", "id", "b", F.floor((F.col("t_us") - F.col("at")) / bin_us).alias("bin")).agg(F.count("*").alias("c"))
    sums = counts.groupBy("key", "bin").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum(F.col("c") * F.col("b")).alias("x"))
    # as many rows as keys and bins
    all_ = whole.select("key", "n", "sb", "qb", F.explode(F.sequence(F.lit(-bins).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")).join(sums, ["key", "bin"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = all_.withColumns({"mean": (zero("s") - F.col("sb")) / F.col("n"), "square": zero("q") - 2 * zero("x") + F.col("qb")})
    spread = F.greatest(F.col("square") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)) / (F.col("n") - 1) / F.col("n")
    out = out.withColumn("sem", F.when(F.col("n") > 1, F.sqrt(spread)))
    few = out.select("n").distinct().select("n", t_quantile(F.lit(0.975), (F.col("n") - 1).cast("double")).alias("t"))
    out = out.join(few, "n")
    sign = F.when(F.col("mean") - F.col("t") * F.col("sem") > 0, 1).when(F.col("mean") + F.col("t") * F.col("sem") < 0, -1).otherwise(0)
    return out.select("key", "bin", "n", "mean", "sem", sign.alias("sign"))
