"""Multitaper transforms of point processes and sampled series as sums over rows, their spectra, coherence and errors.

A row is an event or a sample: series, trial, t (time since the start of the trial) and w (1 for an event, the events of a bin, or the value of
a sample); n is the sum of w. The transform of a trial is a sum over its rows, so tasks send partial sums and a series
or trial with a very large share of the rows is shared by many tasks. A transform has a row for each series, trial,
frequency number i and taper k: (series, trial, i, k, hz, re, im, n). Spectra, coherence and their jackknives are groupings and windows over those
rows. A trial of a series exists if it has a row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from intervalia.operators import distributions
from intervalia.operators.dsp import slepian
from intervalia.sources.fixtures import apart

#: Rows whose transforms are held at a time.
PIECE = 1024
#: Rows of a trial that are sent as they are.
FEW = 128


class Grid:
    """Tapers and frequencies of a trial of n sampling intervals, fs a unit of time; the tapers stand at the middles of the intervals."""

    def __init__(self, n: int, fs: float, bandwidth: float = 3.0, k: int = 5, pad: int = 0, lowest: float = 0.0, highest: float | None = None):
        self.n, self.fs, self.k = n, fs, k
        self.tapers = slepian(n, bandwidth, k) * np.sqrt(fs)
        nfft = max(1 << (int(np.ceil(np.log2(n))) + pad), n)
        hz = np.arange(nfft // 2 + 1) * fs / nfft
        self.hz = hz[(hz >= lowest) & (hz <= (fs / 2 if highest is None else highest))]
        self.middles = (np.arange(n) + 0.5) / fs

    def waves(self, t: np.ndarray) -> np.ndarray:
        """exp(-2 pi i f t) of each time and frequency."""
        return np.exp(-2j * np.pi * t[:, None] * self.hz)

    def at(self, t: np.ndarray) -> np.ndarray:
        """Each taper at each time (times, tapers), by lines between the middles, level beyond the first and last."""
        return np.stack([np.interp(t, self.middles, row) for row in self.tapers], 1)

    def parts(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The share of each row in the transform (rows, frequencies * tapers)."""
        return (self.waves(t)[:, :, None] * (w[:, None] * self.at(t))[:, None, :]).reshape(len(t), -1)

    def of_tapers(self) -> np.ndarray:
        """Transforms of the tapers themselves (frequencies, tapers)."""
        return self.waves(self.middles).T @ self.tapers.T


def transforms(rows: DataFrame, grid: Grid, *, less_rate: bool = False) -> DataFrame:
    """Transforms of rows (series, trial, t, w); less_rate takes off the transform of the mean rate, for events."""

    def part(batches):
        for b in batches:
            b = b.dropna()
            for begin in range(0, len(b), PIECE):
                own = b.iloc[begin : begin + PIECE]
                series, trial = own["series"].to_numpy(), own["trial"].to_numpy()
                first = np.flatnonzero(np.concatenate(([True], (series[1:] != series[:-1]) | (trial[1:] != trial[:-1]))))
                total = np.add.reduceat(grid.parts(own["t"].to_numpy(float), own["w"].to_numpy(float)), first, axis=0)
                count = np.add.reduceat(own["w"].to_numpy(float), first)
                yield pd.DataFrame({"series": series[first], "trial": trial[first], "n": count, "re": list(total.real), "im": list(total.imag)})

    # neighbours in a range of series, trials and times are summed before they are sent; a range can part a trial
    near = rows.select(F.col("series").cast("long").alias("series"), F.col("trial").cast("long").alias("trial"), F.col("t").cast("double").alias("t"), F.col("w").cast("double").alias("w"))
    near = near.repartitionByRange("series", "trial", "t").sortWithinPartitions("series", "trial", "t")
    sums = near.mapInPandas(part, "series long, trial long, n double, re array<double>, im array<double>")
    each = sums.select("series", "trial", "n", F.posexplode(F.arrays_zip("re", "im")).alias("at", "z")).groupBy("series", "trial", "at")
    each = each.agg(F.sum("n").alias("n"), F.sum("z.re").alias("re"), F.sum("z.im").alias("im"))
    i = F.floor(F.col("at") / grid.k).cast("int")
    out = each.select("series", "trial", i.alias("i"), (F.col("at") % grid.k).cast("int").alias("k"), (i * float(grid.hz[1] - grid.hz[0]) + float(grid.hz[0])).alias("hz"), "re", "im", "n")
    if not less_rate:
        return out
    h = grid.of_tapers()
    level = rows.sparkSession.createDataFrame([(a, c, float(h[a, c].real), float(h[a, c].imag)) for a in range(h.shape[0]) for c in range(h.shape[1])], "i int, k int, hr double, hi double")
    share = F.col("n") / grid.n
    # as many rows as frequencies and tapers
    return out.join(F.broadcast(level), ["i", "k"]).select("series", "trial", "i", "k", "hz", (F.col("re") - share * F.col("hr")).alias("re"), (F.col("im") - share * F.col("hi")).alias("im"), "n")


@F.pandas_udf(DoubleType())
def chi2_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(distributions.chi2_quantile(p, dof))


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    """NaN below one degree of freedom."""
    return pd.Series(np.where(dof >= 1, distributions.t_quantile(p, np.maximum(dof, 1)), np.nan))


@lru_cache(maxsize=65536)
def _t_at(p: float, dof: float) -> float:
    """The same of one number, kept for the few that there are."""
    return float(distributions.t_quantile(np.array([p]), np.array([dof]))[0]) if dof >= 1 else np.nan


def _limits(sizes: DataFrame, p: float) -> DataFrame:
    """dof and the quantiles for it, of the few different dof that there are."""
    few = sizes.select("dof", "dim").distinct()
    return few.select("dof", "dim", chi2_quantile(F.lit(1 - p / 2), "dof").alias("high"), chi2_quantile(F.lit(p / 2), "dof").alias("low"), t_quantile(F.lit(1 - p / 2), (F.col("dim") - 1).cast("double")).alias("t"))


def spectra(transform: DataFrame, grid: Grid, p: float = 0.05, *, events: bool = False) -> DataFrame:
    """Power by series and frequency, over trials and tapers, with errors by chi-squared and by leaving one out.

    events: the degrees of freedom are fewer for few events, and `rate` is given.
    """
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    own = Window.partitionBy("series", "i")
    x = transform.select("series", "i", "hz", "k", "n", power.alias("p"))
    x = x.withColumns({"dim": F.count("*").over(own), "total": F.sum("p").over(own)})
    left = F.log((F.col("total") - F.col("p")) / (F.col("dim") - 1))
    out = x.groupBy("series", "i", "hz").agg(F.avg("p").alias("power"), F.count("*").alias("dim"), F.stddev_pop(F.when((F.col("dim") > 1) & (F.col("total") > F.col("p")), left)).alias("sd"), F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("events"))
    free = 2.0 * F.col("dim")
    out = out.withColumn("dof", F.floor(1 / (1 / free + 1 / (2.0 * F.col("events")))).cast("double") if events else free)
    rate = F.col("events") / (F.col("dim") / grid.k * grid.n / grid.fs)
    spread = F.exp(F.col("t") * F.sqrt(F.col("dim") - 1) * F.col("sd"))
    columns = [rate.alias("rate")] if events else []
    return out.join(F.broadcast(_limits(out, p)), ["dof", "dim"]).select("series", "hz", "power", *columns, "dof", (F.col("dof") * F.col("power") / F.col("high")).alias("lower"), (F.col("dof") * F.col("power") / F.col("low")).alias("upper"), (F.col("power") / spread).alias("jack_lower"), (F.col("power") * spread).alias("jack_upper"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Transforms of a beside those of b, which are 0 where b has no row in a trial: series, trial, i, k, hz, xx, yy, xr, xi and events."""
    y = b.select("series", "trial", "i", "k", F.col("re").alias("br"), F.col("im").alias("bi"), F.col("n").alias("events"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # Spark takes what Python functions give for as small as what they read, and would broadcast it
    x = a.join(y.hint("merge"), ["series", "trial", "i", "k"], "left").withColumns({"br": zero("br"), "bi": zero("bi"), "events": F.coalesce("events", F.lit(0))})
    cross = {"xr": F.col("re") * F.col("br") + F.col("im") * F.col("bi"), "xi": F.col("re") * F.col("bi") - F.col("im") * F.col("br")}
    return x.select("series", "trial", "i", "k", "hz", "events", (F.col("re") ** 2 + F.col("im") ** 2).alias("xx"), (F.col("br") ** 2 + F.col("bi") ** 2).alias("yy"), *[c.alias(n) for n, c in cross.items()])


def _coherence(xx: Column, yy: Column, xr: Column, xi: Column) -> Column:
    size = F.sqrt(xx * yy)
    return F.when(size > 0, F.least(F.sqrt(xr * xr + xi * xi) / size, F.lit(1.0)))


def _left_out(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs with dim, the totals of their group, and the sums without the row itself (names with _)."""
    own = Window.partitionBy(*by)
    names = ("xx", "yy", "xr", "xi")
    out = pairs.withColumns({"dim": F.count("*").over(own)} | {f"t_{c}": F.sum(c).over(own) for c in names})
    return out.withColumns({f"_{c}": F.col(f"t_{c}") - F.col(c) for c in names})


def coherence(pairs: DataFrame, p: float = 0.05, *, events: bool = False) -> DataFrame:
    """Coherence and phase by series and frequency over trials and tapers.

    limit: what chance exceeds with probability p. phase_sd: of the theory; jack_phase_sd, lower, upper: by leaving one
    out, in the domain of the inverse hyperbolic tangent. events: fewer degrees of freedom for few events of the second series.
    """
    x = _left_out(pairs, ["series", "i"])
    c = _coherence(*[F.col(f"_{n}") for n in ("xx", "yy", "xr", "xi")])
    size = F.sqrt(F.col("_xr") ** 2 + F.col("_xi") ** 2)
    unit = lambda n: F.when(size > 0, F.col(f"_{n}") / size)
    sums = {n: F.first(f"t_{n}") for n in ("xx", "yy", "xr", "xi")}
    z = F.sqrt(2.0 * F.col("dim") - 2) * F.atanh(c)
    out = x.groupBy("series", "i", "hz").agg(F.first("dim").alias("dim"), F.sum(F.when(F.col("k") == 0, F.col("events"))).alias("events"), *[v.alias(n) for n, v in sums.items()], F.stddev_pop(F.when(c < 1, z)).alias("sd"), F.avg(unit("xr")).alias("ur"), F.avg(unit("xi")).alias("ui"))
    out = out.withColumn("dof", _freedom(events))
    few = out.select("dof").distinct().select("dof", t_quantile(F.lit(1 - p / 2), F.col("dof") - 1).alias("t"))
    # as many rows as there are different degrees of freedom
    return _with_limits(out.join(F.broadcast(few), "dof"), p)


def _freedom(events: bool) -> Column:
    free, count = 2.0 * F.col("dim"), 2.0 * F.col("events")
    return F.floor(count * free / (count + free)).cast("double") if events else free


def _with_limits(out: DataFrame, p: float) -> DataFrame:
    """Coherence, phase and limits from the totals of each series and frequency, and what comes of leaving one out."""
    out = out.withColumn("coherence", _coherence(*[F.col(n) for n in ("xx", "yy", "xr", "xi")])).withColumn("phase", F.atan2("xi", "xr"))
    limit = F.when(F.col("dof") > 2, F.sqrt(1 - F.pow(F.lit(p), 1 / (F.col("dof") / 2 - 1)))).otherwise(1.0)
    root = F.sqrt(2.0 * F.col("dim") - 2)
    middle, half = root * F.atanh(F.when(F.col("coherence") < 1, F.col("coherence"))), F.col("t") * F.sqrt(F.col("dim") - 1) * F.col("sd")
    theory = F.when((F.col("coherence") > 0) & (F.col("dof") > 0), F.sqrt(F.greatest(2 / F.col("dof") * (1 / F.col("coherence") ** 2 - 1), F.lit(0.0))))
    jack = F.sqrt((2.0 * F.col("dim") - 2) * F.greatest(1 - F.sqrt(F.col("ur") ** 2 + F.col("ui") ** 2), F.lit(0.0)))
    return out.select("series", "hz", "coherence", "phase", "dof", limit.alias("limit"), theory.alias("phase_sd"), jack.alias("jack_phase_sd"), F.greatest(F.tanh((middle - half) / root), F.lit(0.0)).alias("lower"), F.tanh((middle + half) / root).alias("upper"))


def spike_field(field: DataFrame, spikes: DataFrame, grid: Grid, p: float = 0.05) -> DataFrame:
    """coherence(paired(transforms(field), transforms(spikes, less_rate=True)), events=True), with no row for each transform.

    Rows of a trial in a range of time are sent as they are if they are few, and as their transform if they are many. A task has the trials of a
    series, as many as its time has room for, whatever the number of rows.
    """
    typed = lambda x, side: x.select(F.lit(side).alias("side"), F.col("series").cast("long").alias("series"), F.col("trial").cast("long").alias("trial"), F.col("t").cast("double").alias("t"), F.col("w").cast("double").alias("w"))

    def part(batches):
        for b in batches:
            b = b.dropna()
            for begin in range(0, len(b), PIECE):
                own = b.iloc[begin : begin + PIECE]
                by, t, w = own[["series", "side", "trial"]].to_numpy(), own["t"].to_numpy(), own["w"].to_numpy()
                first = np.flatnonzero(np.concatenate(([True], (by[1:] != by[:-1]).any(1))))
                out = []
                for lo, hi in zip(first, np.append(first[1:], len(by))):
                    raw = hi - lo <= FEW
                    z = None if raw else grid.parts(t[lo:hi], w[lo:hi]).sum(0)
                    out.append((*by[lo].tolist(), float(w[lo:hi].sum()), raw, t[lo:hi] if raw else z.real, w[lo:hi] if raw else z.imag))
                yield pd.DataFrame(out, columns=["series", "side", "trial", "n", "raw", "x", "y"])

    def each(group):
        trials = np.unique(group.loc[group["side"] == 0, "trial"])
        if not len(trials):
            return pd.DataFrame(columns=["series", *names])
        z, n = np.zeros((2, len(trials), len(grid.hz) * grid.k), complex), np.zeros((2, len(trials)))
        for side, trial, many, raw, x, y in group[["side", "trial", "n", "raw", "x", "y"]].itertuples(index=False):
            k = int(np.searchsorted(trials, trial))
            if k < len(trials) and trials[k] == trial:
                z[side, k] += grid.parts(x, y).sum(0) if raw else x + 1j * y
                n[side, k] += many
        z[1] -= n[1][:, None] / grid.n * level
        # transforms of all trials and tapers by frequency
        a, b = (v.reshape(len(trials), -1, grid.k).transpose(1, 0, 2).reshape(len(grid.hz), -1) for v in z)
        dim, events = a.shape[1], n[1].sum()
        cross = a.conj() * b
        own = [np.abs(a) ** 2, np.abs(b) ** 2, cross.real, cross.imag]
        left = [v.sum(1, keepdims=True) - v for v in own]
        with np.errstate(all="ignore"):
            around, size = np.sqrt(left[2] ** 2 + left[3] ** 2), np.sqrt(left[0] * left[1])
            c = np.where(size > 0, np.minimum(around / size, 1.0), np.nan)
            root = np.where(c < 1, np.sqrt(2.0 * dim - 2) * np.arctanh(np.where(c < 1, c, 0.0)), np.nan)
            mean = lambda v: np.nansum(v, 1) / np.isfinite(v).sum(1)
            sd = np.sqrt(mean((root - mean(root)[:, None]) ** 2))
            ur, ui = (mean(np.where(around > 0, v / around, np.nan)) for v in left[2:])
        dof = np.floor(2 * events * 2 * dim / (2 * events + 2 * dim))
        t = _t_at(1 - p / 2, float(dof) - 1)
        values = dict(zip(names, (grid.hz, dim, events, *(v.sum(1) for v in own), sd, ur, ui, dof, t)))
        return pd.DataFrame({"series": group["series"].iloc[0]} | values)

    names = ["hz", "dim", "events", "xx", "yy", "xr", "xi", "sd", "ur", "ui", "dof", "t"]
    level = grid.of_tapers().reshape(-1)
    rows = typed(field, 0).unionByName(typed(spikes, 1)).repartitionByRange("series", "side", "trial", "t").sortWithinPartitions("series", "side", "trial", "t")
    sent = rows.mapInPandas(part, "series long, side int, trial long, n double, raw boolean, x array<double>, y array<double>")
    out = apart(sent, "series").groupBy("series").applyInPandas(each, "series long, " + ", ".join(f"{c} double" for c in names))
    return _with_limits(out, p)


def two_coherences(pairs: DataFrame, group: Column, p: float = 0.05) -> DataFrame:
    """Whether the coherence differs between two groups of trials: z of the difference, its variance by leaving one out, and whether z is within chance.

    group is 0 or 1. Series with fewer than three transforms in a group at a frequency are left out. Fisher's z has its bias taken off.
    """
    x = _left_out(pairs.withColumn("g", group.cast("int")), ["series", "i", "g"])
    names = ("xx", "yy", "xr", "xi")
    free = 2.0 * F.col("dim")
    x = x.withColumns({"z": F.atanh(_coherence(*[F.col(f"t_{n}") for n in names])) - 1 / (free - 2), "z1": F.atanh(_coherence(*[F.col(f"_{n}") for n in names])) - 1 / (free - 4)}).where("dim > 2")
    whole = x.groupBy("series", "i", "hz").agg(*[F.first(F.when(F.col("g") == g, F.col(c)), True).alias(f"{c}_{g}") for g in (0, 1) for c in ("z", "dim")]).where("dim_0 IS NOT NULL AND dim_1 IS NOT NULL")
    term = lambda g, less: 1 / (2.0 * F.col(f"dim_{g}") - less)
    whole = whole.withColumn("dz", (F.col("z_0") - F.col("z_1")) / F.sqrt(term(0, 2) + term(1, 2)))
    each = x.select("series", "i", "g", "dim", "z1").join(whole, ["series", "i"])
    one = F.when(F.col("g") == 0, (F.col("z1") - F.col("z_1")) / F.sqrt(term(0, 4) + term(1, 2))).otherwise((F.col("z_0") - F.col("z1")) / F.sqrt(term(0, 2) + term(1, 4)))
    pseudo = F.col("dim") * F.col("dz") - (F.col("dim") - 1) * one
    by_group = each.withColumn("pseudo", pseudo).groupBy("series", "i", "hz", "g").agg(F.first("dz").alias("dz"), (F.var_pop("pseudo") / (F.first("dim") - 1)).alias("v"))
    edge = float(distributions.normal_quantile(1 - p / 2))
    out = by_group.groupBy("series", "i", "hz").agg(F.first("dz").alias("dz"), F.sum("v").alias("variance"))
    return out.select("series", "hz", "dz", "variance", (F.abs("dz") <= edge).alias("alike"))


def in_trials(points: DataFrame, width_us: int, unit_us: int, weight: Column | None = None) -> DataFrame:
    """Rows for transforms from (series, t_us): trials of one width from the epoch on, time in units since the start of the trial."""
    trial = F.floor(F.col("t_us") / width_us)
    return points.select("series", trial.alias("trial"), ((F.col("t_us") - trial * width_us) / unit_us).alias("t"), (F.lit(1.0) if weight is None else weight).alias("w"))


def counted(points: DataFrame, width_us: int, unit_us: int, fs: float) -> DataFrame:
    """The same for events that are counted by sampling interval: their number, at its middle."""
    x = in_trials(points, width_us, unit_us)
    return x.groupBy("series", "trial", F.floor(F.col("t") * fs).alias("s")).agg(F.sum("w").alias("w")).select("series", "trial", ((F.col("s") + 0.5) / fs).alias("t"), "w")


def about(triggers: DataFrame, points: DataFrame, before_us: int, after_us: int, unit_us: int) -> DataFrame:
    """Rows for transforms of the points (series, t_us) about triggers (series, id, t_us): a trial is a trigger, its start before_us ahead of it.

    A point at the end of a trial is left out, so trials that touch do not share it.
    """
    from intervalia.operators.rangejoin import points_in

    width = before_us + after_us
    trials = triggers.select("series", F.col("id").alias("trial"), (F.col("t_us") - before_us).alias("start_us"), (F.col("t_us") + after_us - 1).alias("stop_us"))
    near = points_in(trials, points.select("series", "t_us"), width)
    return near.select("series", "trial", ((F.col("t_us") - F.col("start_us")) / unit_us).alias("t"), F.lit(1.0).alias("w"))


def by_trial(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs with each trial as a series of its own, numbered in `series`, for coherence over tapers alone; and the numbers."""
    trials = pairs.select("series", "trial").distinct()
    return pairs.withColumn("series", F.xxhash64("series", "trial")), trials.select(F.xxhash64("series", "trial").alias("pair"), "series", "trial")


def sampled(points: DataFrame, width_us: int, unit_us: int, fs: float) -> DataFrame:
    """The same for events with a value: the sum of the values of each sampling interval, at its middle."""
    x = in_trials(points, width_us, unit_us, F.col("value"))
    return x.groupBy("series", "trial", F.floor(F.col("t") * fs).alias("s")).agg(F.sum("w").alias("w")).select("series", "trial", ((F.col("s") + 0.5) / fs).alias("t"), "w")
