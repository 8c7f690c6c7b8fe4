"""Boosted trees for labels of 1 and -1: gentle, real and modest AdaBoost.

A model is fitted on a bounded sample (FIT_ROWS rows of least hash, a documented parameter) and applied to every row.
A weak learner is a tree of so many levels whose leaves each carry a weight of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that a model is fitted on.
FIT_ROWS = 5000
ROUNDS, LEVELS, CUTS = 100, 3, 32


@dataclass
class Tree:
    """Splits in heap order: feature (-1 where there is none) and threshold, and the value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.value)))):
            f = self.feature[at]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[at])
            at = 2 * at + 1 + right
        return at - len(self.feature)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]


def grown(binned: np.ndarray, cuts: np.ndarray, y: np.ndarray, w: np.ndarray, levels: int) -> Tree:
    """The tree that best fits y with weights w by squares, by splits at the cuts; its values are still 0."""
    n_features, bins = binned.shape[1], cuts.shape[1] + 1
    feature, threshold = np.full(2**levels - 1, -1), np.zeros(2**levels - 1)
    at = np.zeros(len(y), np.int64)
    for node in range(len(feature)):
        own = np.flatnonzero(at == node)
        if len(own) and np.ptp(y[own]) > 0:
            flat = (binned[own] + np.arange(n_features) * bins).ravel()
            sw = np.bincount(flat, np.repeat(w[own], n_features), n_features * bins).reshape(n_features, bins).cumsum(1)
            sy = np.bincount(flat, np.repeat(w[own] * y[own], n_features), n_features * bins).reshape(n_features, bins).cumsum(1)
            lw, ly = sw[:, :-1], sy[:, :-1]
            rw, ry = sw[:, -1:] - lw, sy[:, -1:] - ly
            with np.errstate(invalid="ignore", divide="ignore"):
                gain = np.where((lw > 1e-12) & (rw > 1e-12), ly**2 / lw + ry**2 / rw, -np.inf)
            f, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if np.isfinite(gain[f, c]):
                feature[node], threshold[node] = f, cuts[f, c]
                at[own] = 2 * node + 1 + (binned[own, f] > c)
                continue
        at[own] = 2 * node + 1
    return Tree(feature, threshold, np.zeros(2**levels))


def fit(x: np.ndarray, y: np.ndarray, kind: str = "gentle", rounds: int = ROUNDS, levels: int = LEVELS) -> list[Tree]:
    """Trees whose values add up to the score of a row; y is 1 or -1. One class alone gives a constant."""
    if kind not in ("gentle", "real", "modest"):
        raise ValueError(f"no boosting named {kind}")
    if not len(y):
        return []
    cuts = np.quantile(x, np.linspace(0, 1, CUTS + 1)[1:-1], axis=0).T
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], 1)
    score, w, trees = np.zeros(len(y)), np.full(len(y), 1 / len(y)), []
    for _ in range(rounds):
        tree = grown(binned, cuts, y, w, levels)
        leaf = tree.leaf(x)
        size = len(tree.value)
        p, q = (np.bincount(leaf, w * (y == s), size) for s in (1, -1))
        if kind == "gentle":
            value = np.divide(p - q, p + q, out=np.zeros(size), where=p + q > 0)
        elif kind == "real":
            value = 0.5 * np.log((p + 1e-9) / (q + 1e-9))
        else:
            away = 1 / np.maximum(w, 1e-300)
            away /= away.sum()
            p0, q0 = (np.bincount(leaf, away * (y == s), size) for s in (1, -1))
            value = p * (1 - p0) - q * (1 - q0)
        tree.value = value
        trees.append(tree)
        score = score + value[leaf]
        w = np.exp(-np.clip(y * score, -500, 500))
        w /= w.sum()
    return trees


def scores(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.sum([t(x) for t in trees], 0) if trees else np.zeros(len(x))


def sample(rows: DataFrame, most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """v and y of at most so many rows (vec_id, v, y), those of least hash."""
    got = rows.where("v IS NOT NULL AND y IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").select("v", "y").limit(most).toPandas()
    return (np.stack(got["v"].to_numpy()) if len(got) else np.zeros((0, 1))), got["y"].to_numpy(float)


def classified(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """vec_id, y, score and predicted (1 where the score is above 0, else -1) of every row with v."""

    def each(batches):
        for b in batches:
            s = scores(trees, np.stack(b["v"].to_numpy())) if len(b) else np.zeros(0)
            yield pd.DataFrame({"vec_id": b["vec_id"], "y": b["y"], "score": s, "predicted": np.where(s > 0, 1, -1)})

    return rows.where("v IS NOT NULL").select("vec_id", "v", "y").mapInPandas(each, "vec_id long, y int, score double, predicted int")


def folds(rows: DataFrame, k: int = 5, **options) -> DataFrame:
    """fold and what classified() gives: every row is classified by a model that did not see its fold."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(k)).cast("int"))
    out = None
    for f in range(k):
        model = fit(*sample(rows.where(F.col("fold") != f)), **options)
        part = classified(rows.where(F.col("fold") == f), model).withColumn("fold", F.lit(f))
        out = part if out is None else out.union(part)
    return out
