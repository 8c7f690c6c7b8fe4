"""Local polynomial regression along an axis, with the number of neighbours by generalised cross-validation.

Points are dealt in buckets of ranks with a halo of as many ranks as there are neighbours, so a task holds a bucket and its
halo, whatever the length of a series. Ranks come from counts per stretch of the axis and ranks within a stretch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervalia.sources.fixtures import apart
from intervalia.sources.shared import written

#: Points of a bucket.
BUCKET = 512
#: Points that are fitted at a time.
PIECE = 128


def ranked(rows: DataFrame, stretch: float) -> DataFrame:
    """rows (series, id, x, y) with r, the place in the series by x, then id, from 0; and n, its length.

    A window holds the points of one stretch of a series; what is summed over a whole series is a row for each stretch.
    """
    x = rows.where("series IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND NOT isnan(y)").withColumn("_s", F.floor(F.col("x") / stretch))
    counts = x.groupBy("series", "_s").agg(F.count("*").alias("_c"))
    own = Window.partitionBy("series")
    counts = counts.select("series", "_s", (F.sum("_c").over(own.orderBy("_s")) - F.col("_c")).alias("_before"), F.sum("_c").over(own).alias("n"))
    inner = F.row_number().over(Window.partitionBy("series", "_s").orderBy("x", "id")) - 1
    return x.withColumn("_r", inner).join(counts, ["series", "_s"]).select("series", "id", "x", "y", (F.col("_before") + F.col("_r")).alias("r"), "n")


def local_fits(x: np.ndarray, y: np.ndarray, at: np.ndarray, place: np.ndarray, k: int, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit, leverage and squared norm of the weights of the points `at`, from the k nearest of x, which is sorted, with tricube weights.

    place is where each point stands in x. The farthest of the k has weight 0. Where all k are at one place they weigh the same. A fit that is
    not determined is the one of least norm about its point. Leverage is that of a point of x.
    """
    fit, leverage, norm = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    for begin in range(0, len(at), PIECE):
        own = slice(begin, begin + PIECE)
        near = place[own, None] + np.arange(-k, k + 1)
        there = (near >= 0) & (near < len(x))
        near = np.clip(near, 0, len(x) - 1)
        gap = np.where(there, x[near] - at[own, None], np.inf)
        far = np.abs(gap)
        width = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        scaled = np.where(there, gap, 0.0) / np.where(width > 0, width, 1.0)
        w = np.where(there & (far < width), (1 - np.minimum(np.abs(scaled), 1) ** 3) ** 3, 0.0)
        w = np.where(width > 0, w, (there & (far == 0)).astype(float))
        basis = scaled[:, :, None] ** np.arange(degree + 1)
        inverse = np.linalg.pinv(np.einsum("pi,pia,pib->pab", w, basis, basis), rcond=1e-10, hermitian=True)
        weights = w * np.einsum("pa,pia->pi", inverse[:, 0], basis)
        fit[own] = (weights * y[near]).sum(1)
        leverage[own] = inverse[:, 0, 0]
        norm[own] = (weights**2).sum(1)
    return fit, leverage, norm


def regressions(rows: DataFrame, ks: list[int], stretch: float, degree: int = 2) -> DataFrame:
    """series, id, x, y, k, fit, leverage and norm of every point (series, id, x, y) for each number of neighbours.

    A series of fewer points than k takes all of them.
    """
    most = max(ks)
    r = ranked(rows, stretch)
    halo = F.explode(F.sequence(F.greatest(F.floor((F.col("r") - most) / BUCKET), F.lit(0)), F.floor(F.least(F.col("r") + most, F.col("n") - 1) / BUCKET)))

    def fit(key, points):
        points = points.sort_values("r", kind="stable")
        core = np.flatnonzero((points["r"] // BUCKET == key[1]).to_numpy())
        x, y, n = points["x"].to_numpy(), points["y"].to_numpy(), int(points["n"].iloc[0])
        out = []
        for k in ks:
            f, h, s = local_fits(x, y, x[core], core, min(k, n), degree)
            out.append(points.iloc[core][["series", "id", "x", "y"]].assign(k=k, fit=f, leverage=h, norm=s))
        return pd.concat(out)

    typed = r.select(F.col("series").cast("long").alias("series"), F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "r", "n", halo.alias("b"))
    return apart(typed, "series", "b").groupBy("series", "b").applyInPandas(fit, "series long, id long, x double, y double, k int, fit double, leverage double, norm double")


def cross_validation(fits: DataFrame) -> DataFrame:
    """n, rss, trace, gcv, lcv, aic and sigma of each series and k.

    gcv: n times the squared residuals over the squared degrees left, null where none is; lcv: squared residuals of the points when left
    out; aic: n times the log of the mean squared residual and twice the trace; sigma: the deviation about the fit.
    """
    gap = F.col("y") - F.col("fit")
    out = F.when(1 - F.col("leverage") > 1e-9, gap * gap / (1 - F.col("leverage")) / (1 - F.col("leverage")))
    sums = fits.groupBy("series", "k").agg(F.count("*").alias("n"), F.sum(gap * gap).alias("rss"), F.sum("leverage").alias("trace"), F.sum("norm").alias("_two"), F.when(F.count(out) == F.count("*"), F.sum(out)).alias("lcv"))
    left, free = F.col("n") - F.col("trace"), F.col("n") - 2 * F.col("trace") + F.col("_two")
    sums = sums.withColumns({"gcv": F.when(left > 1e-6, F.col("n") * F.col("rss") / (left * left)), "aic": F.when(F.col("rss") > 0, F.col("n") * F.log(F.col("rss") / F.col("n")) + 2 * F.col("trace")), "sigma": F.when(free > 1e-6, F.sqrt(F.col("rss") / free))})
    return sums.select("series", "k", "n", "rss", "trace", "gcv", "lcv", "aic", "sigma")


def smoothed(fits: DataFrame, share: float = 0.95) -> DataFrame:
    """The fits of each series with the k of least gcv, and limits that hold the curve with probability share at a point.

    The smallest k of equals; where none has any, the largest, without limits.
    """
    from intervalia.operators.distributions import normal_quantile

    edge = float(normal_quantile((1 + share) / 2))
    # read twice: for the scores, and for the fits of the best
    fits = written(fits, "local-fits")
    order = F.struct(F.col("gcv").isNull(), "gcv", F.when(F.col("gcv").isNull(), -F.col("k")).otherwise(F.col("k")), "k", "sigma")
    best = cross_validation(fits).groupBy("series").agg(F.min(order).alias("m")).select("series", F.col("m.k").alias("k"), F.col("m.sigma").alias("sigma"))
    half = edge * F.col("sigma") * F.sqrt("norm")
    return fits.join(best, ["series", "k"]).select("series", "id", "x", "y", "k", "fit", "leverage", (F.col("fit") - half).alias("lower"), (F.col("fit") + half).alias("upper"))


def predicted(rows: DataFrame, at: DataFrame, k: int, stretch: float, degree: int = 2) -> DataFrame:
    """series, id, x and fit at other points of the axis, at (series, id, x), from rows (series, id, x, y); null where a series has no rows.

    A point takes its place among the rows by their number before it, so it meets the k on either side of it whatever the length of a series.
    """
    known = ranked(rows, stretch).select("series", "x", "y", "r", "n")
    asked = at.where("series IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    both = known.select("series", "x", F.lit(1).alias("one"), F.lit(None).cast("long").alias("id")).unionByName(asked.select("series", F.col("x").cast("double").alias("x"), F.lit(0).alias("one"), F.col("id").cast("long").alias("id")))
    both = both.withColumn("_s", F.floor(F.col("x") / stretch))
    counts = both.groupBy("series", "_s").agg(F.sum("one").alias("_c"))
    own = Window.partitionBy("series")
    counts = counts.select("series", "_s", (F.sum("_c").over(own.orderBy("_s")) - F.col("_c")).alias("_before"), F.sum("_c").over(own).alias("n"))
    # a point that is asked for comes before the rows of its place
    before = F.sum("one").over(Window.partitionBy("series", "_s").orderBy("x", "one").rowsBetween(Window.unboundedPreceding, -1))
    asked = both.withColumn("_r", F.coalesce(before, F.lit(0))).where("one = 0").join(counts, ["series", "_s"])
    asked = asked.select("series", "id", "x", F.lit(None).cast("double").alias("y"), (F.col("_before") + F.col("_r")).alias("r"), "n", F.floor((F.col("_before") + F.col("_r")) / BUCKET).alias("b"))
    halo = F.explode(F.sequence(F.greatest(F.floor((F.col("r") - k) / BUCKET), F.lit(0)), F.floor((F.col("r") + k) / BUCKET)))
    points = known.select("series", F.lit(None).cast("long").alias("id"), "x", "y", "r", "n", halo.alias("b")).unionByName(asked)

    def fit(own):
        asked, own = own[own["y"].isna()], own[own["y"].notna()].sort_values("r", kind="stable")
        x, y = own["x"].to_numpy(float), own["y"].to_numpy(float)
        out = asked[["series", "id", "x"]].assign(fit=np.nan)
        if len(asked) and len(own):
            place = asked["r"].to_numpy() - int(own["r"].iloc[0])
            out["fit"] = local_fits(x, y, asked["x"].to_numpy(float), place, min(k, int(own["n"].iloc[0])), degree)[0]
        return out

    typed = points.select(F.col("series").cast("long").alias("series"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "r", "n", "b")
    out = apart(typed, "series", "b").groupBy("series", "b").applyInPandas(fit, "series long, id long, x double, fit double")
    return out.select("series", "id", "x", F.when(~F.isnan("fit"), F.col("fit")).alias("fit"))
