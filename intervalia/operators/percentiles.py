"""Exact percentiles of the distances within each label, with no row for a pair.

Doubles above zero are in the order of their bits. A pass over all pairs counts them by leading bits; the next one counts, by more bits, those
that share them with the two values which the percentile lies between; the last one has all bits. A task sends a row for each number of its tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.operators import tiles
from intervalia.sources.shared import written

#: Bits that a pass leaves out.
LEFT_OUT = (42, 28, 0)
NOT_A_NUMBER = int(np.array([np.nan]).view(np.int64)[0])


def _counted(left_out: int, before: int | None):
    """Pairs of a tile by the bits of their distances, of those whose leading bits are in `at`."""

    def each(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"label": [], "bits": [], "n": []}).astype("int64")
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        seen: dict[int, int] = {}
        for k in range(0, len(x), tiles.STRIP):
            d = tiles.euclidean(x[k : k + tiles.STRIP], y[k:] if same else y)
            d = d[np.triu(np.ones(d.shape, bool), 1)] if same else d.reshape(-1)
            d[np.isnan(d)] = np.nan  # of one sign, so that they come last
            bits = d.view(np.int64)
            if before is None:  # two million at most
                n = np.bincount(bits >> left_out)
                values = np.flatnonzero(n)
                n = n[values]
            else:
                lo, hi = a["at"].iloc[0]
                leading = bits >> before
                values, n = np.unique(bits[(leading == lo) | (leading == hi)] >> left_out, return_counts=True)
            for value, many in zip(values.tolist(), n.tolist()):
                seen[value] = seen.get(value, 0) + many
        return pd.DataFrame({"label": a["label"].iloc[0], "bits": list(seen), "n": list(seen.values())}).astype("int64")

    return each


def _narrowed(share: float, left_out: int, before: int | None):
    """The leading bits of the two values of a label, their places among the pairs that have these, and the number of all pairs."""

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bits")
        bits, n = group["bits"].to_numpy(), group["n"].to_numpy()
        if before is None:
            pairs, real = int(n.sum()), int(n[bits < NOT_A_NUMBER >> left_out].sum())
            place = share * (max(real, 1) - 1)
            at, rank = None, [int(np.floor(place)), int(np.ceil(place))]
        else:
            pairs, real, at, rank = (group[c].iloc[0] for c in ("pairs", "real", "at", "rank"))
        found, places = [], []
        for k, r in enumerate(rank):
            own = np.ones(len(bits), bool) if at is None else bits >> (before - left_out) == at[k]
            ends = np.cumsum(n[own])
            slot = int(np.searchsorted(ends, r, side="right"))
            found.append(int(bits[own][slot]))
            places.append(int(r - ends[slot] + n[own][slot]))
        return pd.DataFrame({"label": group["label"].iloc[0], "at": [found], "rank": [places], "pairs": pairs, "real": real})

    return each


def within_labels(vectors: DataFrame, share: float) -> DataFrame:
    """label, value and pairs: the percentile of the Euclidean distances of the pairs of vectors (vec_id, v, label) of each label, and the number of pairs.

    Distances that are no number count as pairs, but have no part in the percentile.
    """
    rows = vectors.where("v IS NOT NULL").select("vec_id", "v", "label")
    held, before = None, None
    for left_out in LEFT_OUT:
        items = rows if held is None else rows.join(F.broadcast(held.select("label", "at")), "label")  # a row for each label
        counts = tiles.tiled(items, "vec_id", _counted(left_out, before), "label int, bits long, n long", None, "label", None)
        counts = counts.groupBy("label", "bits").agg(F.sum("n").alias("n"))
        if held is not None:
            counts = counts.join(F.broadcast(held), "label")
        held = written(counts.groupBy("label").applyInPandas(_narrowed(share, left_out, before), "label int, at array<long>, rank array<long>, pairs long, real long"), "percentiles")
        before = left_out
    place = F.lit(share) * (F.greatest("real", F.lit(1)) - 1)

    def values(batches):
        for b in batches:
            lo, hi = (np.array([x[k] for x in b["at"]], np.int64).view(float) for k in (0, 1))
            over = b["place"].to_numpy() - np.floor(b["place"].to_numpy())
            yield pd.DataFrame({"label": b["label"], "value": np.where(lo == hi, lo, (1 - over) * lo + over * hi), "pairs": b["pairs"]})

    return held.select("label", "at", "pairs", place.alias("place")).mapInPandas(values, "label int, value double, pairs long")
