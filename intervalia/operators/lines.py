"""Removal of sine lines: an F test of each frequency of a window, complex amplitudes, subtraction, windows cross-faded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.operators import distributions
from intervalia.operators.dsp import slepian

#: Rounds of a window at most; each takes off what is significant of what the one before left.
ROUNDS = 20


class Lines:
    """The test of windows of n samples, fs a second: false lines in a window have about the chance p."""

    def __init__(self, n: int, fs: float, bandwidth: float = 3.0, k: int = 5, pad: int = 2, p: float = 0.05):
        self.n, self.fs, self.k = n, fs, k
        self.tapers = slepian(n, bandwidth, k)
        self.nfft = max(1 << (int(np.ceil(np.log2(n))) + pad), n)
        # the odd tapers sum to nothing
        self.sums = self.tapers.sum(1)
        self.sums[1::2] = 0
        self.limit = float(distributions.f_quantile(1 - p / n, 2, 2 * k - 2))

    def test(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """F and complex amplitude of each frequency of rfft."""
        j = np.fft.rfft(self.tapers * x, self.nfft)
        weight = (self.sums**2).sum()
        line = (self.sums[:, None] * j).sum(0) / weight
        rest = (np.abs(j - self.sums[:, None] * line) ** 2).sum(0)
        return (self.k - 1) * np.abs(line) ** 2 * weight / np.maximum(rest, 1e-300), line

    def found(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and amplitudes of the significant peaks of F; the level and the highest frequency are no lines."""
        f, line = self.test(x)
        inner = np.arange(1, len(f) - 1)
        peak = inner[(f[inner] > self.limit) & (f[inner] >= f[inner - 1]) & (f[inner] > f[inner + 1])]
        # a peak within the bandwidth of a higher one is its flank
        width = int(np.ceil(self.nfft / self.n))
        keep = [a for a in peak if not any(abs(a - b) <= width and f[b] > f[a] for b in peak)]
        return np.array(keep, int), line[keep]

    def fitted(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
        """The lines of a window together, and the frequency and size of each, until none is significant."""
        t, total, seen = np.arange(self.n), np.zeros(self.n), []
        scale = np.sqrt(np.mean(x**2))
        for _ in range(ROUNDS):
            left = x - total
            # what is left at the precision of the numbers has no lines
            if not scale or np.sqrt(np.mean(left**2)) < 1e-9 * scale:
                break
            at, amplitude = self.found(left)
            if not len(at):
                break
            for a, c in zip(at, amplitude):
                total += 2 * (c * np.exp(2j * np.pi * a * t / self.nfft)).real
                seen.append((a * self.fs / self.nfft, 2 * abs(c)))
        return total, seen


def fade(n: int, overlap: int, steep: float = 10.0) -> np.ndarray:
    """Weights of a window: a sigmoid up over the overlap at its start and down at its end."""
    w = np.ones(n)
    if overlap:
        up = 1 / (1 + np.exp(-steep * (np.arange(1, overlap + 1) - (overlap + 1) / 2) / overlap))
        w[:overlap] *= up
        w[n - overlap :] *= up[::-1]
    return w


def windows(rows: DataFrame, size: int, step: int) -> DataFrame:
    """sid, start and part (array) of the windows of rows (sid, x array); the last one ends with the signal. Shorter signals have none."""
    n = F.size("x")
    starts = F.array_union(F.sequence(F.lit(0), n - size, F.lit(step)), F.array(n - size))
    w = rows.where(F.size("x") >= size).select("sid", "x", F.explode(starts).alias("start"))
    return w.select("sid", "start", F.slice("x", F.col("start") + 1, size).alias("part"))


def lines(rows: DataFrame, size: int, step: int, fs: float, **options) -> DataFrame:
    """sid, start, hz and amplitude of the lines of each window."""
    test = Lines(size, fs, **options)

    def run(batches):
        for b in batches:
            out = [(sid, start, hz, a) for sid, start, x in zip(b["sid"], b["start"], b["part"]) for hz, a in test.fitted(np.asarray(x, float))[1]]
            yield pd.DataFrame(out, columns=["sid", "start", "hz", "amplitude"])

    return windows(rows, size, step).mapInPandas(run, "sid long, start int, hz double, amplitude double")


def without_lines(rows: DataFrame, size: int, step: int, fs: float, **options) -> DataFrame:
    """sid, k (from 1), y and line of the samples of rows (sid, x): y is x less the lines of the windows about it.

    Where windows overlap their lines are averaged with weights that fade. Signals shorter than a window stay as they are.
    """
    test, weight = Lines(size, fs, **options), fade(size, size - step)

    def run(batches):
        for b in batches:
            for sid, start, x in zip(b["sid"], b["start"], b["part"]):
                yield pd.DataFrame({"sid": sid, "k": start + np.arange(1, size + 1), "f": weight * test.fitted(np.asarray(x, float))[0], "w": weight})

    fits = windows(rows, size, step).mapInPandas(run, "sid long, k int, f double, w double")
    fits = fits.groupBy("sid", "k").agg((F.sum("f") / F.sum("w")).alias("line"))
    x = rows.select("sid", F.posexplode("x").alias("p", "x")).select("sid", (F.col("p") + 1).alias("k"), "x")
    line = F.coalesce("line", F.lit(0.0))
    return x.join(fits, ["sid", "k"], "left").select("sid", "k", (F.col("x") - line).alias("y"), line.alias("line"))
