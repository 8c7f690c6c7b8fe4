"""Best regions of templates in long series, by warping with free start and end.

A match of a template of n frames starts at any frame of a series; its path takes the next frame of both, or of one of them for PENALTY more,
and stays within MARGIN frames of the diagonal from its start, so it spans at most n + MARGIN frames. Series are dealt in chunks
of starts with as many frames after them, and all starts of a chunk are warped at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.operators.warp import MARGIN, PENALTY
from intervalia.sources.fixtures import apart

#: Starts of a chunk.
CHUNK = 4096


def from_every_start(template: np.ndarray, x: np.ndarray, starts: int, margin: int = MARGIN, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Length and distance of the best match from each of the first starts frames; template and x are features by frames.

    Of equal distances the shortest match counts; where the series ends too soon for any the length is 0 and the distance infinite.
    """
    n, m, wide = template.shape[1], x.shape[1], 2 * margin + 1
    padded = np.concatenate([x, np.full((x.shape[0], n + margin + starts), np.nan)], 1)
    at = np.arange(starts)
    best = np.full((wide, starts), np.inf)
    for i in range(n):
        before, best = best, np.full((wide, starts), np.inf)
        for d in range(wide):
            j = i + d - margin
            if j < 0:
                continue
            frame = at + j
            cost = ((padded[:, np.minimum(frame, padded.shape[1] - 1)] - template[:, i, None]) ** 2).sum(0)
            cost = np.where(frame < m, cost, np.inf)
            if i == 0 and j == 0:
                reach = np.zeros(starts)
            else:
                # the next frame of both, of the template alone, of the series alone
                reach = before[d] if i else np.full(starts, np.inf)
                if i and d + 1 < wide:
                    reach = np.minimum(reach, before[d + 1] + penalty)
                if d:
                    reach = np.minimum(reach, best[d - 1] + penalty)
            best[d] = reach + cost
    end = best.argmin(0)
    far = best[end, at]
    return np.where(np.isfinite(far), n + end - margin, 0), np.sqrt(far)


def chunked(frames: DataFrame, reach: int, chunk: int = CHUNK) -> DataFrame:
    """frames (series, k, v: features of frame k from 0) with the chunks c that need them: that of k and those before it within reach."""
    c = F.explode(F.sequence(F.greatest(F.floor((F.col("k") - reach) / chunk), F.lit(0)), F.floor(F.col("k") / chunk)))
    return frames.select("series", "k", "v", c.alias("c"))


def scored(frames: DataFrame, templates: list[tuple[int, np.ndarray]], margin: int = MARGIN, penalty: float = PENALTY, chunk: int = CHUNK) -> DataFrame:
    """series, template, start, stop (exclusive) and distance of the best match from every frame. Frames of a series are numbered without gaps.

    templates are few; each is a number and features by frames.
    """
    reach = max(t.shape[1] for _, t in templates) + margin

    def search(key, own):
        own = own.sort_values("k")
        first = int(key[1]) * chunk
        x = np.stack(own["v"].to_numpy()).T.astype(float)
        starts = int((own["k"] < first + chunk).sum())
        out = []
        for number, t in templates:
            length, far = from_every_start(t, x, starts, margin, penalty)
            some = length > 0
            begin = (first + np.arange(starts))[some]
            out.append(pd.DataFrame({"series": key[0], "template": number, "start": begin, "stop": begin + length[some], "distance": far[some]}))
        return pd.concat(out)

    return apart(chunked(frames, reach, chunk), "series", "c").groupBy("series", "c").applyInPandas(search, "series long, template long, start long, stop long, distance double")


def best_regions(scores: DataFrame) -> DataFrame:
    """series, template, start, stop and distance of the best match of each template in each series, the first of equals."""
    best = scores.groupBy("series", "template").agg(F.min(F.struct("distance", "start", "stop")).alias("m"))
    return best.select("series", "template", "m.start", "m.stop", "m.distance")


def agreed(best: DataFrame) -> DataFrame:
    """series, start, stop and score of the mean region of all templates in each series."""
    return best.groupBy("series").agg(F.avg("start").alias("start"), F.avg("stop").alias("stop"), F.avg("distance").alias("score"), F.count("*").alias("templates"))


def dips(scores: DataFrame, most: float, apart: int) -> DataFrame:
    """Scores of distance up to most that no better one of the same series and template starts within apart frames of."""
    from pyspark.sql import Window

    x = scores.where(F.col("distance") <= most).withColumn("c", F.floor(F.col("start") / apart))
    # a window holds three stretches of apart frames
    near = x.select("series", "template", "start", "distance", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("at"), F.col("c").alias("own"), "stop")
    w = Window.partitionBy("series", "template", "at").orderBy("start").rangeBetween(-apart, apart)
    least = F.min(F.struct("distance", "start")).over(w)
    return near.withColumn("least", least).where((F.col("at") == F.col("own")) & (F.col("least.start") == F.col("start"))).select("series", "template", "start", "stop", "distance")
