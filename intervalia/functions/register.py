"""Vectorised functions that users can call from SQL, and a way to add their own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from intervalia.operators import dsp, warp


@pandas_udf(DoubleType())
def warp_distance(a: pd.Series, b: pd.Series, features: pd.Series) -> pd.Series:
    """Time-warped distance of two series, each features by frames, feature after feature; null where one is null."""
    out = np.full(len(a), np.nan)
    groups: dict[tuple, list[int]] = {}
    for k, (x, y, f) in enumerate(zip(a, b, features)):
        if x is not None and y is not None:
            groups.setdefault((int(f), len(x), len(y)), []).append(k)
    for (f, _, _), rows in groups.items():
        x, y = (np.stack([np.asarray(s.iloc[k], float).reshape(f, -1) for k in rows]) for s in (a, b))
        out[rows] = warp.warp_block(x, y)
    return pd.Series(out)


@pandas_udf(ArrayType(DoubleType()))
def low_pass(x: pd.Series, fs: pd.Series, hz: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else dsp.low_pass(np.asarray(v, float), r, h) for v, r, h in zip(x, fs, hz)])


@pandas_udf(ArrayType(DoubleType()))
def high_pass(x: pd.Series, fs: pd.Series, hz: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else dsp.high_pass(np.asarray(v, float), r, h) for v, r, h in zip(x, fs, hz)])


@pandas_udf(ArrayType(DoubleType()))
def power_curve(x: pd.Series, fs: pd.Series, window: pd.Series, step: pd.Series) -> pd.Series:
    """Total multitaper power of the windows of a series."""
    return pd.Series([None if v is None else dsp.multitaper(np.asarray(v, float), r, w, s)[0].sum(1) for v, r, w, s in zip(x, fs, window, step)])


BUILT_IN = {"warp_distance": warp_distance, "low_pass": low_pass, "high_pass": high_pass, "power_curve": power_curve}


def register(spark: SparkSession, more: dict[str, Callable] | None = None) -> list[str]:
    """Registers the built-in functions, and others (names to pandas_udf functions), for SQL; returns their names."""
    found = BUILT_IN | (more or {})
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)
