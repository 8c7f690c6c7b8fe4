"""Functions of many rows in SQL: table functions, and reductions of a user's own.

A reduction that adds up (Reduction) is summed in parts by the tasks, so a group may be of any size. A grouped function
(register_grouped) sees a whole group at once and is for groups that fit a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType


class SplitOverlapping:
    """n pieces of an interval of one length, each overlapping the next by a share of its length."""

    def eval(self, start: int, stop: int, n: int, overlap: float):
        if None in (start, stop, n, overlap) or n < 1:
            return
        length = (stop - start) / (n - (n - 1) * overlap)
        for k in range(n):
            begin = start + k * length * (1 - overlap)
            yield k + 1, begin, begin + length


class Grams:
    """Runs of n neighbours of an array of labels, joined by a blank, with their place."""

    def eval(self, labels: list, n: int):
        if labels is None or n is None or n < 1:
            return
        for k in range(len(labels) - n + 1):
            yield k + 1, " ".join("" if x is None else str(x) for x in labels[k : k + n])


class Dips:
    """Places and values of the local minima of an array below a limit; of a level stretch the first place."""

    def eval(self, values: list, limit: float):
        if values is None or limit is None:
            return
        for k, v in enumerate(values):
            before = values[k - 1] if k else np.inf
            after = next((w for w in values[k + 1 :] if w != v), np.inf) if k + 1 < len(values) else np.inf
            if v is not None and v < limit and before is not None and after is not None and before > v and after > v:
                yield k + 1, float(v)


TABLE_FUNCTIONS = {
    "split_overlapping": (SplitOverlapping, "piece int, start double, stop double"),
    "grams": (Grams, "place int, gram string"),
    "dips": (Dips, "place int, value double"),
}


def activity_fraction(x: pd.Series) -> float:
    """The squared mean over the mean square: 1 if all are alike, 1 / n if one has everything."""
    x = x.dropna().to_numpy(float)
    square = (x * x).mean() if len(x) else 0.0
    return float(x.mean() ** 2 / square) if square > 0 else float("nan")


def median_deviation(x: pd.Series) -> float:
    """The median distance from the median."""
    x = x.dropna().to_numpy(float)
    return float(np.median(np.abs(x - np.median(x)))) if len(x) else float("nan")


GROUPED = {"activity_fraction": activity_fraction, "median_deviation": median_deviation}


def grouped(f: Callable[[pd.Series], float]):
    """f of all values of a group as an aggregate."""

    def one(x: pd.Series) -> float:
        return f(x)

    one.__annotations__ = {"x": pd.Series, "return": float}
    return pandas_udf(one, DoubleType())


def register(spark: SparkSession, more: dict[str, Callable[[pd.Series], float]] | None = None) -> list[str]:
    """Registers the table functions, the grouped functions and others of a series of values for SQL; returns all names."""
    for name, (f, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(f, returnType=schema))
    found = GROUPED | (more or {})
    for name, f in found.items():
        spark.udf.register(name, grouped(f))
    return sorted([*TABLE_FUNCTIONS, *found])


@dataclass
class Reduction:
    """part gives some sums of an array of values, finish what the sums of all parts come to; names are those of the result."""

    part: Callable[[np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], list]
    names: list[str]


def moments(x: np.ndarray) -> np.ndarray:
    return np.array([len(x), x.sum(), (x**2).sum(), (x**3).sum(), (x**4).sum()], float)


def shape(s: np.ndarray) -> list:
    n, m = s[0], s[1:] / s[0]
    v = m[1] - m[0] ** 2
    if v <= 0:
        return [n, m[0], 0.0, None, None]
    skew = (m[2] - 3 * m[0] * m[1] + 2 * m[0] ** 3) / v**1.5
    return [n, m[0], v**0.5, skew, (m[3] - 4 * m[0] * m[2] + 6 * m[0] ** 2 * m[1] - 3 * m[0] ** 4) / v**2]


SHAPE = Reduction(moments, shape, ["n", "mean", "sd", "skew", "kurtosis"])


def reduced(rows: DataFrame, key: str, value: str, reduction: Reduction) -> DataFrame:
    """key (long) and the results of a reduction of value by key; null keys and values and NaN are left out."""

    def part(batches):
        for b in batches:
            b = b.dropna()
            sums = [(k, i, s) for k, x in b.groupby("key")["value"] for i, s in enumerate(np.asarray(reduction.part(x.to_numpy()), float))]
            yield pd.DataFrame(sums, columns=["key", "i", "s"])

    def finish(batches):
        for b in batches:
            out = [[k, *reduction.finish(np.asarray(s, float))] for k, s in zip(b["key"], b["s"])]
            yield pd.DataFrame(out, columns=[key, *reduction.names])

    x = rows.select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value")).mapInPandas(part, "key long, i int, s double")
    sums = x.groupBy("key", "i").agg(F.sum("s").alias("s")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("z"))
    return sums.select("key", F.col("z.s").alias("s")).mapInPandas(finish, f"{key} long, " + ", ".join(f"{n} double" for n in reduction.names))
