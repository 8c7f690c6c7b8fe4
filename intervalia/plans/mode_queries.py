"""Queries of channels together, changes of power, and best regions of templates; tests compare their rows with direct forms (M, K)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from intervalia.operators import modes, quadratic, regions
from intervalia.plans.registry import query
from intervalia.plans.spectral_queries import segments
from intervalia.sources.fixtures import FS, signals, vectors

#: Channels of a block, and samples of a window that is tested for change.
CHANNELS, CHANGING = 8, 256


def block():
    return F.floor(F.col("series") / CHANNELS)


@query("m09_space_modes")
def m09(spark, d):
    """Singular modes in space of eight signals at each frequency of each segment."""
    return modes.space_modes(segments(spark, d), block())


@query("m10_coherence_matrix")
def m10(spark, d):
    """Coherence and phase of all channels of a block over segments and tapers."""
    return modes.coherence_matrix(modes.cross_matrix(segments(spark, d), block()))


@query("m11_matrix_modes")
def m11(spark, d):
    """How much the channels of a block are one at each frequency."""
    return modes.matrix_modes(modes.cross_matrix(segments(spark, d), block()))


@query("m12_change_of_power")
def m12(spark, d):
    """The index of non-stationarity of each window of 256 samples and frequency, windows half apart."""
    starts = F.explode(F.sequence(F.lit(0), F.size("x") - CHANGING, F.lit(CHANGING // 2)))
    w = signals(spark, d).where(F.size("x") >= CHANGING).select("sid", "x", starts.alias("start")).select("sid", "start", F.slice("x", F.col("start") + 1, CHANGING).alias("part"))
    hz = np.arange(CHANGING // 2 + 1) * FS / CHANGING

    def run(batches):
        for b in batches:
            for sid, start, x in zip(b["sid"], b["start"], b["part"]):
                yield pd.DataFrame({"sid": sid, "start": start, "hz": hz, "change": quadratic.index(np.asarray(x, float))})

    return w.mapInPandas(run, "sid long, start int, hz double, change double")


def song(spark, d):
    """series, k, v: eight vectors on end as a series of frames of four features, sixteen of each vector."""
    v = vectors(spark, d).where("v IS NOT NULL AND size(v) = 64")
    frame = F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.struct(t.alias("t"), F.array(*[F.get("v", t + 16 * f) * 10 for f in range(4)]).alias("v"))))
    place = F.row_number().over(regions_window()) - 1
    x = v.select("vec_id", F.floor(F.col("vec_id") / 8).alias("series"), "v").withColumn("place", place)
    return x.select("series", "place", frame.alias("f")).select("series", (F.col("place") * 16 + F.col("f.t")).alias("k"), F.col("f.v").alias("v"))


def regions_window():
    from pyspark.sql import Window

    # at most eight vectors
    return Window.partitionBy(F.floor(F.col("vec_id") / 8)).orderBy("vec_id")


def examples(spark, d) -> list[tuple[int, np.ndarray]]:
    """The mean vector of each label as a template; as many as there are labels."""
    v = vectors(spark, d).where("v IS NOT NULL AND size(v) = 64")
    means = v.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    found: dict[int, np.ndarray] = {}
    for label, k, m in means.collect():
        found.setdefault(int(label), np.zeros(64))[k] = 10 * m
    return [(label, found[label].reshape(4, 16)) for label in sorted(found)]


@query("k13_best_regions")
def k13(spark, d):
    """Where the mean vector of each label fits best in each series, by warping with free ends."""
    return regions.best_regions(regions.scored(song(spark, d), examples(spark, d)))


@query("k14_agreed_regions")
def k14(spark, d):
    """The mean of the best regions of all templates in each series."""
    return regions.agreed(k13(spark, d))


@query("k15_match_dips")
def k15(spark, d):
    """Matches of templates that no better one starts within half a template of."""
    return regions.dips(regions.scored(song(spark, d), examples(spark, d)), 1e9, 8)
