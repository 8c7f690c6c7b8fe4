"""Queries of point-process spectra, coherence and their errors; tests compare their rows with direct sums (M, Q)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from intervalia.operators import spectra
from intervalia.plans.registry import query
from intervalia.sources.fixtures import FS, intervals, points, signals

#: Trials of six days, sampled each hour; times in days.
TRIAL_US, DAY_US = 6 * 86_400_000_000, 86_400_000_000
HOURS = spectra.Grid(144, 24.0, highest=4.0)
#: Segments of a signal.
SEGMENT = spectra.Grid(128, FS, highest=250.0)


def views(spark, d):
    """Transforms of the views of each user, less their mean rate."""
    return spectra.transforms(spectra.in_trials(points(spark, d), TRIAL_US, DAY_US), HOURS, less_rate=True)


def spending(spark, d):
    """The values of the purchases of each user, summed by the hour, as rows of transforms."""
    bought = intervals(spark, d, "purchase").select("series", F.col("start_us").alias("t_us"), ((F.col("stop_us") - F.col("start_us")) / 60e6).alias("value"))
    return spectra.sampled(bought, TRIAL_US, DAY_US, HOURS.fs)


def segments(spark, d, shift: int = 0):
    """Transforms of the segments of each signal; shift takes the signal so many places on in its stead."""
    x = signals(spark, d).select((F.col("sid") - shift).alias("series"), F.posexplode("x").alias("s", "w"))
    inside = x.select("series", F.floor(F.col("s") / SEGMENT.n).alias("trial"), ((F.col("s") % SEGMENT.n + 0.5) / FS).alias("t"), "w")
    return spectra.transforms(inside, SEGMENT)


@query("m05_point_spectrum")
def m05(spark, d):
    """Spectrum, rate and errors of the views of each user."""
    return spectra.spectra(views(spark, d), HOURS, events=True)


@query("m06_spike_field_coherence")
def m06(spark, d):
    """Coherence of the hourly spending of each user with the views."""
    return spectra.spike_field(spending(spark, d), spectra.in_trials(points(spark, d), TRIAL_US, DAY_US), HOURS)


@query("m07_point_spectrogram")
def m07(spark, d):
    """The spectrum of each trial by itself, with its rate."""
    x = views(spark, d)
    return x.groupBy("series", "trial", "hz").agg(F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("power"), (F.first("n") / (HOURS.n / HOURS.fs)).alias("rate"))


@query("m08_segment_coherence")
def m08(spark, d):
    """Coherence of each signal with the next over segments and tapers, with errors."""
    return spectra.coherence(spectra.paired(segments(spark, d), segments(spark, d, 1)))


@query("q14_spectral_errors")
def q14_spectral(spark, d):
    """The spectrum of the segments of each signal with chi-squared and jackknife limits."""
    return spectra.spectra(segments(spark, d), SEGMENT)


@query("q16_two_group_coherence")
def q16_coherence(spark, d):
    """Whether a signal and the next are as coherent in the first half of their segments as in the second."""
    return spectra.two_coherences(spectra.paired(segments(spark, d), segments(spark, d, 1)), F.col("trial") >= 2)


@query("m13_binned_point_spectrum")
def m13(spark, d):
    """The spectrum of hourly counts of views of each user."""
    return spectra.spectra(spectra.transforms(spectra.counted(points(spark, d), TRIAL_US, DAY_US, HOURS.fs), HOURS, less_rate=True), HOURS, events=True)


#: Two days about a trigger, sampled each hour.
ABOUT = spectra.Grid(48, 24.0, highest=4.0)


@query("m14_triggered_point_spectrum")
def m14(spark, d):
    """The spectrum of the views of each user within a day of a purchase."""
    bought = intervals(spark, d, "purchase").select("series", "id", F.col("start_us").alias("t_us"))
    near = spectra.about(bought, points(spark, d), DAY_US, DAY_US, DAY_US)
    return spectra.spectra(spectra.transforms(near, ABOUT, less_rate=True), ABOUT, events=True)


@query("m15_spike_field_coherogram")
def m15(spark, d):
    """Coherence of the spending of each user with the views, trial by trial over the tapers."""
    pairs, trials = spectra.by_trial(spectra.paired(spectra.transforms(spending(spark, d), HOURS), views(spark, d)).where("events > 0"))
    c = spectra.coherence(pairs, events=True)
    return c.withColumnRenamed("series", "pair").join(trials.hint("merge"), "pair").select("series", "trial", "hz", "coherence", "phase", "limit")


@query("m16_welch_spectrum")
def m16(spark, d):
    """Mean periodograms of signals over windows of 128 samples half apart, weighed by a raised cosine, per hertz."""
    n, hop = 128, 64
    x = signals(spark, d).select("sid", F.posexplode("x").alias("s", "x"))
    last = F.floor(F.col("s") / hop)
    first = F.greatest(F.floor((F.col("s") - n) / hop) + 1, F.lit(0))
    w = x.select("sid", "s", "x", F.explode(F.sequence(first, last)).alias("w"))
    w = w.groupBy("sid", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "x"))), lambda v: v["x"]).alias("x")).where(F.size("x") == n)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    hz = np.arange(n // 2 + 1) * FS / n
    double = np.where((np.arange(n // 2 + 1) == 0) | (np.arange(n // 2 + 1) == n // 2), 1.0, 2.0)

    def run(batches):
        for b in batches:
            for sid, part in zip(b["sid"], b["x"]):
                part = np.asarray(part, float)
                yield pd.DataFrame({"sid": sid, "hz": hz, "p": double * np.abs(np.fft.rfft((part - part.mean()) * taper)) ** 2 / (FS * (taper**2).sum())})

    return w.select("sid", "x").mapInPandas(run, "sid long, hz double, p double").groupBy("sid", "hz").agg(F.avg("p").alias("power"), F.count("*").alias("windows"))


@query("d27_downsample", "WITH fr AS (SELECT vec_id // 8 AS sid, (vec_id % 8) * 64 + k - 1 AS s, x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) SELECT sid, s // 4 AS k, x AS y FROM fr WHERE s % 4 = 0")
def d27(spark, d):
    """Every fourth sample of signals."""
    x = signals(spark, d).select("sid", F.posexplode("x").alias("s", "y"))
    return x.where("s % 4 = 0").select("sid", F.floor(F.col("s") / 4).alias("k"), "y")


def expressed(rows, expression: str):
    """sid, k and y of samples (sid, x array) by an expression of SQL over x (the sample), t (seconds) and n (length)."""
    s = rows.select("sid", F.size("x").alias("n"), F.posexplode("x").alias("k", "x")).withColumn("t", F.col("k") / FS)
    return s.select("sid", "k", F.expr(expression).cast("double").alias("y"))


@query("d28_expression_filter", "WITH fr AS (SELECT vec_id // 8 AS sid, (vec_id % 8) * 64 + k - 1 AS s, x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) SELECT sid, s AS k, round(x * exp(-(s / 1000.0)) + 0.5 * abs(x), 9) AS y FROM fr")
def d28(spark, d):
    """Signals by a formula of a user's own."""
    return expressed(signals(spark, d), "x * exp(-t) + 0.5 * abs(x)").withColumn("y", F.round("y", 9))
