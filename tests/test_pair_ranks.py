"""Ranks of all pairs, against sorting them, over several strips."""

import os
import uuid

import numpy as np
import pytest
from test_sizes import frame

from intervalia.operators import pair_ranks
from intervalia.plans import registry
from intervalia.sources import shared


def ranks_of(d, i, j):
    """Rank over number by (d, i, j)."""
    p = np.empty(len(d))
    p[np.lexsort((j, i, d))] = np.arange(1, len(d) + 1) / len(d)
    return p


@pytest.mark.parametrize("dense", [True, False])
def test_ranks_with_ties_over_strips(spark, monkeypatch, dense):
    """Copies, few different distances, and tables with and without a place for each."""
    monkeypatch.setattr(pair_ranks, "LEAST", 500)
    monkeypatch.setattr(pair_ranks, "AT_ONCE", 300)
    if not dense:
        monkeypatch.setattr(pair_ranks, "DENSE", 0)
        monkeypatch.setattr(pair_ranks, "STRETCH", 1 << 10)
    v = np.random.default_rng(4).integers(0, 3, (150, 3)).astype(float)
    v[100:] += np.random.default_rng(5).normal(size=(50, 3))
    swept = pair_ranks.Swept(frame(spark, v), pair_ranks.Euclidean, pair_ranks.City)
    assert len(swept.cuts) > 5 and swept.dense == [dense] * 2
    got = swept.ranks(lambda s, rows, p, q: pair_ranks.pairs(s, rows, p=p, q=q), "i long, j long, p double, q double").toPandas().sort_values(["i", "j"])
    i, j = np.triu_indices(150, 1)
    gap = v[i] - v[j]
    assert got["i"].tolist() == i.tolist() and got["j"].tolist() == j.tolist()
    assert np.array_equal(got["p"], ranks_of(np.floor(np.sqrt((gap**2).sum(1)) * 1e6 + 0.5), i, j))
    assert np.array_equal(got["q"], ranks_of(np.floor(np.abs(gap).sum(1) * 1e6 + 0.5), i, j))


def test_vectors_that_are_null_rank_last(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, None, 0), (3, [3.0, 4.0], 0)], "vec_id long, v array<double>, label int")
    got = pair_ranks.Swept(rows, pair_ranks.Euclidean).ranks(lambda s, r, p: pair_ranks.pairs(s, r, p=p * 3), "i long, j long, p double").collect()
    assert {(r["i"], r["j"]): round(r["p"]) for r in got} == {(1, 3): 1, (1, 2): 2, (2, 3): 3}


def size_on_disk(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


@pytest.mark.parametrize("name", ["f01_empirical_rank", "f03_geometric_fusion", "f04_weighted_fusion", "f05_length_infusion", "f09_local_global_fused", "f10_fusion_of_two_distances"])
def test_pairs_are_not_kept(spark, tmp_path, monkeypatch, name):
    """No pairs are written, sorted or joined: 124,750 of them took more than 1.2 MB."""
    monkeypatch.setattr(shared, "shared_folder", lambda spark, tag: f"file://{tmp_path}/{tag}-{uuid.uuid4().hex}")
    x = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = x._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "row_number" not in plan
    assert 0 < size_on_disk(tmp_path) < 124_750 * (8 if name.startswith("f10") else 4)


def test_looked_up_pairs_once(spark):
    """Distances are looked up where they are formed: nothing is joined."""
    assert "Join" not in registry.queries()["f02_rank_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
