"""Standard intervals of repeated songs: where their boundaries fall by kernel votes, and which intervals match them.

Boundaries are rows (key, t). A vote is a parabola of one width, 1 at its own place, and votes add up on a grid. What meets in one task is the
grid of a key, not its votes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def votes(boundaries: DataFrame, step: float, width: float) -> DataFrame:
    """key, g (number of the grid point from 0) and votes."""
    reach = int(np.ceil(width / step))
    at = F.floor(F.col("t") / step)
    near = F.explode(F.sequence(F.greatest(at - reach, F.lit(0)), at + reach + 1))
    z = (F.col("g") * step - F.col("t")) / width
    x = boundaries.where("t >= 0").select("key", "t", near.alias("g")).withColumn("v", 1 - z * z).where("v > 0")
    return x.groupBy("key", "g").agg(F.sum("v").alias("votes"))


def peaks_of(g: np.ndarray, v: np.ndarray, least: float, apart: int) -> np.ndarray:
    """Grid points of the local maxima of at least a height, none within apart points of a higher one; of a level top the first point."""
    height = dict(zip(g.tolist(), v.tolist()))
    tops = []
    for k in sorted(height):
        after = k + 1
        while height.get(after, 0.0) == height[k]:
            after += 1
        if height[k] >= least and height.get(k - 1, 0.0) < height[k] > height.get(after, 0.0):
            tops.append(k)
    kept: list[int] = []
    for k in sorted(tops, key=lambda k: (-height[k], k)):
        if all(abs(k - j) > apart for j in kept):
            kept.append(k)
    return np.array(sorted(kept), int)


def peaks(voted: DataFrame, least: DataFrame, apart: int) -> DataFrame:
    """key, place (from 1), g and votes of the peaks; least has key and least, the height that a peak must reach."""

    def find(own):
        own = own.sort_values("g")
        at = peaks_of(own["g"].to_numpy(), own["votes"].to_numpy(), float(own["least"].iloc[0]), apart)
        height = own.set_index("g")["votes"]
        return pd.DataFrame({"key": own["key"].iloc[0], "place": np.arange(1, len(at) + 1), "g": at, "votes": height.loc[at].to_numpy()})

    return voted.join(least, "key").groupBy("key").applyInPandas(find, "key string, place int, g long, votes double")


def standard(intervals: DataFrame, songs: DataFrame, step: float, width: float, share: float = 0.35) -> DataFrame:
    """key, place, start and stop of the standard intervals of rows (key, start, stop): the peaks of the votes of starts and of stops, in order.

    songs has key and n, the number of songs; a peak needs the votes of share of them. Those of one kind beyond the number of the other are left out.
    """
    least = songs.select("key", (F.col("n") * share).alias("least"))
    found = {}
    for c in ("start", "stop"):
        voted = votes(intervals.select("key", F.col(c).alias("t")), step, width)
        found[c] = peaks(voted, least, int(round(width / step))).select("key", "place", (F.col("g") * step).alias(c))
    return found["start"].join(found["stop"], ["key", "place"]).select("key", "place", "start", "stop").where("stop > start")


def matched(intervals: DataFrame, standards: DataFrame, width: float) -> DataFrame:
    """key, id and place of the intervals (key, id, start, stop) both of whose ends are within two widths of those of exactly one standard.

    A key has as many standards as its grid has room for.
    """
    near = intervals.join(standards.withColumnsRenamed({"start": "s0", "stop": "s1"}), "key").where((F.abs(F.col("start") - F.col("s0")) < 2 * width) & (F.abs(F.col("stop") - F.col("s1")) < 2 * width))
    return near.groupBy("key", "id").agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n = 1").drop("n")

