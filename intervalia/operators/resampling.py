"""Permutation tests by partial sums, and fits of durations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signs(ids: np.ndarray, trials: int) -> np.ndarray:
    """1 or -1 for each id and trial, from a mix of both; trial 0 is all 1."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(trials, dtype=np.uint64)[None] * np.uint64(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    out = np.where((x >> np.uint64(63)) == 0, 1.0, -1.0)
    out[:, 0] = 1.0
    return out


def sign_flips(rows: DataFrame, trials: int = 1000) -> DataFrame:
    """key, n, t and p of paired differences d by key: the share of trials with a t as far from 0 as that of the data.

    rows has key, id and d. Each task sums its differences under all trials, so what is shuffled is a row for
    each key, trial and task, however many rows a key has.
    """

    def part(batches):
        for b in batches:
            b = b.dropna()
            for key, own in b.groupby("key"):
                for at in range(0, len(own), 2048):
                    piece = own.iloc[at : at + 2048]
                    d = piece["d"].to_numpy()
                    s = d @ signs(piece["id"].to_numpy(), trials)
                    yield pd.DataFrame({"key": key, "trial": np.arange(trials), "n": len(d), "s": s, "q": float(d @ d)})

    sums = rows.select("key", "id", "d").mapInPandas(part, "key long, trial int, n long, s double, q double")
    sums = sums.groupBy("key", "trial").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).where("n > 1")
    spread = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) / F.col("n"))
    t = sums.withColumn("t", F.when(spread > 0, F.col("s") / F.col("n") / spread))
    own = t.where("trial = 0").select("key", F.col("t").alias("t0"))
    return t.join(own, "key").groupBy("key").agg(F.first("n").alias("n"), F.first("t0").alias("t"), F.avg((F.abs("t") >= F.abs("t0") - 1e-9).cast("double")).alias("p"))


def decay(mean: float, lo: float, hi: float) -> float:
    """The time constant of an exponential cut to (lo, hi) with this mean; infinite from the middle on."""
    if not lo < mean < (lo + hi) / 2:
        return math.inf if mean >= (lo + hi) / 2 else 0.0
    width, a, b = hi - lo, 1e-9 * (hi - lo), 1e6 * (hi - lo)
    for _ in range(200):
        tau = math.sqrt(a * b)
        x = width / tau
        a, b = (tau, b) if tau + lo - (width / math.expm1(x) if x < 700 else 0.0) < mean else (a, tau)
    return tau


def durations(rows: DataFrame, lo: float, hi: float) -> DataFrame:
    """key, n, tau and ks of the lengths x inside (lo, hi) by key.

    tau is the likeliest time constant of an exponential cut to the interval; ks is the largest gap between the
    shares of lengths and the exponential of their mean, times the root of n. Ranks are by key.
    """
    from pyspark.sql import Window

    inside = rows.where((F.col("x") > lo) & (F.col("x") < hi)).select("key", "x")
    stats = inside.groupBy("key").agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    r = F.row_number().over(Window.partitionBy("key").orderBy("x"))
    cdf = 1 - F.exp(-F.col("x") / F.col("m"))
    gaps = inside.withColumn("r", r).join(stats, "key").select("key", F.greatest(F.abs(F.col("r") / F.col("n") - cdf), F.abs((F.col("r") - 1) / F.col("n") - cdf)).alias("gap"))
    ks = gaps.groupBy("key").agg(F.max("gap").alias("gap"))

    def fit(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "n": b["n"], "tau": [decay(m, lo, hi) for m in b["m"]], "ks": b["gap"] * np.sqrt(b["n"])})

    return stats.join(ks, "key").mapInPandas(fit, "key long, n long, tau double, ks double")


def bump(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Height, place, width and r2 of the Gaussian that fits y by least squares, by damped Gauss-Newton steps."""
    if len(x) < 4 or not (y > 0).any():
        return 0.0, 0.0, 0.0, 0.0
    w = y / y.sum()
    at = float((w * x).sum())
    p = np.array([y.max(), at, max(float(np.sqrt(2 * (w * (x - at) ** 2).sum())), float(x[1] - x[0]))])
    model = lambda p: p[0] * np.exp(-(((x - p[1]) / p[2]) ** 2))
    damp, miss = 1e-3, float(((y - model(p)) ** 2).sum())
    for _ in range(200):
        e = np.exp(-(((x - p[1]) / p[2]) ** 2))
        j = np.stack([e, p[0] * e * 2 * (x - p[1]) / p[2] ** 2, p[0] * e * 2 * (x - p[1]) ** 2 / p[2] ** 3], 1)
        h = j.T @ j
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ (y - model(p)), rcond=None)[0]
        new = p + step
        now = float(((y - model(new)) ** 2).sum()) if new[2] != 0 else math.inf
        if now < miss:
            done = miss - now < 1e-14 * max(miss, 1e-300)
            p, miss, damp = new, now, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    total = float(((y - y.mean()) ** 2).sum())
    return float(p[0]), float(p[1]), float(abs(p[2])), 1 - miss / total if total > 0 else 0.0


def peaks(rows: DataFrame, width: float, upto: float, lo: float, hi: float) -> DataFrame:
    """key, tau, height, place, spread and r2: the Gaussian in what a histogram of x has above its exponential."""
    bins = int(round(upto / width)) + 1
    n = rows.groupBy("key").agg(F.count("*").alias("all"), F.avg(F.when((F.col("x") > lo) & (F.col("x") < hi), F.col("x"))).alias("m"))
    at = F.least(F.greatest(F.round(F.col("x") / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy("key", at.alias("b")).count().groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("b", "count"))).alias("h"))

    def fit(batches):
        for f in batches:
            out = []
            for key, h, total, m in zip(f["key"], f["h"], f["all"], f["m"]):
                x, y = width * np.arange(bins), np.zeros(bins)
                for b, c in dict(h).items():
                    y[b] = c / total / width
                tau = decay(m, lo, hi) if m == m and m is not None else math.inf
                rest = y - (np.exp(-x / tau) / tau if 0 < tau < math.inf else 0.0)
                out.append((key, tau, *bump(x, np.maximum(rest, 0))))
            yield pd.DataFrame(out, columns=["key", "tau", "height", "place", "spread", "r2"])

    return counts.join(n, "key").mapInPandas(fit, "key long, tau double, height double, place double, spread double, r2 double")
