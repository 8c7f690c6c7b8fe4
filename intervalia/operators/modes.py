"""Channels together: cross-spectral and coherence matrices of blocks of channels, and their modes in space.

Transforms (series, trial, i, k, hz, re, im) come with a block; a series is a channel of its block. Products of channels are joined by
block, trial, frequency and taper and summed over trials and tapers by Spark; what meets in one task is a matrix of channels, or the transforms of
the channels of a block in one trial. A channel without rows in a trial counts as zero there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervalia.sources.fixtures import apart


def cross_matrix(transform: DataFrame, block: Column) -> DataFrame:
    """block, i, hz, a, b, re and im of the mean of conj(Ja) Jb over trials and tapers, for all channels a and b of a block."""
    x = transform.select(block.alias("block"), "series", "trial", "i", "k", "hz", "re", "im")
    size = x.select("block", "trial", "i", "k").distinct().groupBy("block", "i").agg(F.count("*").alias("n"))
    y = x.select("block", "trial", "i", "k", F.col("series").alias("b"), F.col("re").alias("br"), F.col("im").alias("bi"))
    met = x.join(y, ["block", "trial", "i", "k"])
    re, im = F.col("re") * F.col("br") + F.col("im") * F.col("bi"), F.col("re") * F.col("bi") - F.col("im") * F.col("br")
    sums = met.groupBy("block", "i", "hz", F.col("series").alias("a"), "b").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return sums.join(size, ["block", "i"]).select("block", "i", "hz", "a", "b", (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


def coherence_matrix(cross: DataFrame) -> DataFrame:
    """block, hz, a, b, coherence and phase."""
    own = cross.where("a = b").select("block", "i", "a", F.col("re").alias("p"))
    x = cross.join(own, ["block", "i", "a"]).join(own.select("block", "i", F.col("a").alias("b"), F.col("p").alias("q")), ["block", "i", "b"])
    size = F.sqrt(F.col("p") * F.col("q"))
    return x.select("block", "hz", "a", "b", F.when(size > 0, F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / size).alias("coherence"), F.atan2("im", "re").alias("phase"))


def matrix_modes(cross: DataFrame) -> DataFrame:
    """block, hz, total (share of the first singular value), evenness (geometric over arithmetic mean) and leading, the sizes of the
    channels in the first mode by channel."""

    def modes(key, own):
        at = {c: k for k, c in enumerate(sorted(own["a"].unique()))}
        m = np.zeros((len(at), len(at)), complex)
        m[own["a"].map(at), own["b"].map(at)] = own["re"].to_numpy() + 1j * own["im"].to_numpy()
        u, s, _ = np.linalg.svd(m)
        some = s.sum() > 0
        evenness = float(np.exp(np.log(s).mean()) / s.mean()) if s.min() > 0 else 0.0
        return pd.DataFrame({"block": [key[0]], "hz": [own["hz"].iloc[0]], "total": [float(s[0] / s.sum()) if some else None], "evenness": [evenness if some else None], "leading": [np.abs(u[:, 0])]})

    return cross.groupBy("block", "i").applyInPandas(modes, "block long, hz double, total double, evenness double, leading array<double>")


def space_modes(transform: DataFrame, block: Column) -> DataFrame:
    """block, trial, hz, mode (from 1), value and space of the singular modes of channels by tapers; space has the sizes of the channels."""
    x = transform.select(block.alias("block"), "series", "trial", "i", "k", "hz", "re", "im")

    def modes(key, own):
        channels = {c: n for n, c in enumerate(sorted(own["series"].unique()))}
        i = np.sort(own["i"].unique())
        m = np.zeros((len(i), len(channels), int(own["k"].max()) + 1), complex)
        m[np.searchsorted(i, own["i"]), own["series"].map(channels), own["k"]] = own["re"].to_numpy() + 1j * own["im"].to_numpy()
        hz = own.drop_duplicates("i").sort_values("i")["hz"].to_numpy()
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        rows = s.shape[1]
        return pd.DataFrame({"block": key[0], "trial": key[1], "hz": np.repeat(hz, rows), "mode": np.tile(np.arange(1, rows + 1), len(i)), "value": s.reshape(-1), "space": list(np.abs(u).transpose(0, 2, 1).reshape(-1, len(channels)))})

    return apart(x, "block", "trial").groupBy("block", "trial").applyInPandas(modes, "block long, trial long, hz double, mode int, value double, space array<double>")
