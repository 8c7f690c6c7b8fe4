"""Codebooks, evoked means, trees and regressions of the tables against plain forms."""

import numpy as np
import pandas as pd
import pytest

from intervalia.operators import codebooks, factorial, linkage, neighbours, ranks, tiles, triggered
from intervalia.operators.dsp import local_line
from intervalia.plans import analysis_queries as aq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    v = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    return v["vec_id"].to_numpy(), v["label"].to_numpy(), np.stack(v["embedding"].to_numpy()).astype(float)


def lloyd(x, centres, rounds, far):
    for _ in range(rounds):
        near = far(x, centres).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(new - centres).max() < 1e-9:
            break
        centres = new
    d = far(x, centres)
    return centres, d.min(1).sum(), d.argmin(1)


def plain_squared(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(2)


@pytest.mark.parametrize("metric, far", [(codebooks.squared, plain_squared), (codebooks.city, lambda x, c: np.abs(x[:, None] - c[None]).sum(2))])
def test_best_of_restarts(spark, table, metric, far):
    from intervalia.sources.fixtures import vectors

    _, _, x = table
    v = vectors(spark, SF)
    first = codebooks.seeds(v, 6, 4)
    assert len({tuple(map(tuple, c)) for c in first}) == 4
    centres, totals = codebooks.fitted(v, 6, 4, 8, metric)
    want = [lloyd(x, c, 8, far) for c in first]
    assert np.allclose(totals, [w[1] for w in want])
    best = want[int(np.argmin([w[1] for w in want]))]
    assert np.allclose(centres, best[0][np.unique(best[2])])


def test_codebook_query(spark, table):
    ids, _, x = table
    v, centres = aq.code(spark, SF)
    got = aq.c26(spark, SF).toPandas().sort_values("vec_id")
    d = np.sort(plain_squared(x, centres), 1)
    assert got["vec_id"].tolist() == ids.tolist() and (got["cluster"] == plain_squared(x, centres).argmin(1)).all()
    assert np.allclose(got["d"], d[:, 0]) and np.allclose(got["second"], d[:, 1]) and np.allclose(got["ratio"], d[:, 0] / d[:, 1])
    # thirty restarts are at least as good as the Spark ML codebook of as many centres
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    f = v.withColumn("features", array_to_vector("v"))
    assert d[:, 0].sum() <= 1.05 * KMeans(k=20, seed=3, maxIter=30).fit(f).summary.trainingCost
    by = got.groupby("cluster").agg(n=("d", "size"), distance=("d", "mean"), ratio=("ratio", "mean"))
    for r in aq.c27(spark, SF).collect():
        assert r.n == by.loc[r.cluster, "n"] and np.isclose(r.distance, by.loc[r.cluster, "distance"]) and np.isclose(r.ratio, by.loc[r.cluster, "ratio"])
    assert aq.c28(spark, SF).count() == len(ids)


def test_few_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    assert codebooks.assigned(none, codebooks.fitted(none, 3, 2)[0]).count() == 0
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 1.0]), (3, None)], "vec_id long, v array<double>")
    got = sorted(map(tuple, codebooks.assigned(two, codebooks.fitted(two, 3, 2)[0]).collect()))
    assert [r[0] for r in got] == [1, 2] and all(r[2] == 0 for r in got)


def test_tree_neighbours(spark, table):
    ids, label, x = table
    got = aq.c29(spark, SF).toPandas()
    for b in sorted(set(label))[:3]:
        own = np.flatnonzero(label == b)
        tree = linkage.merges(np.sqrt(plain_squared(x[own], x[own])), "average")
        cut = {k: linkage.cut(tree, len(own), k) for k in range(2, 10)}
        for k in range(2, 10):
            rows = got[(got["block"] == b) & (got["k"] == k)].set_index("cluster")
            assert sorted(rows.index) == sorted(set(cut[k]))
            for c, r in rows.iterrows():
                inside = cut[k] == c
                assert r["n"] == inside.sum() and r["member"] == ids[own][inside].min()
                if k > 2:
                    above = set(cut[k - 1][inside])
                    assert above == {r["above"]}
                    others = sorted(set(cut[k][cut[k - 1] == r["above"]]) - {c})
                    assert (not others and np.isnan(r["sibling"])) or r["sibling"] == others[0]
                if k < 9:
                    assert r["parts"] == ",".join(map(str, sorted(set(cut[k + 1][inside]))))


def test_evoked(spark, table):
    ids, label, x = table
    got = aq.t29(spark, SF).toPandas()
    for b in sorted(set(label)):
        own = np.flatnonzero(label == b)
        rows = got[got["key"] == b].sort_values("k")
        times = np.array([np.random.default_rng([1, int(i)]).poisson(1.0, 20) for i in ids[own]])
        draws = np.array([local_line(times[:, k] @ x[own] / times[:, k].sum(), 8, 4) for k in range(20)])
        assert (rows["n"] == len(own)).all() and np.allclose(rows["mean"], local_line(x[own].mean(0), 8, 4))
        assert np.allclose(rows["sem"], x[own].std(0, ddof=1) / np.sqrt(len(own))) and np.allclose(rows["error"], draws.std(0))


def test_evoked_of_few(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [3.0, 2.0]), (1, 3, [9.0]), (2, 1, None), (3, 5, [4.0])], "key long, id long, v array<double>")
    got = {(r.key, r.k): (r.n, r.mean, r.sem, r.error) for r in triggered.evoked(rows, 5).collect()}
    assert got[1, 1][:3] == (2, 2.0, 1.0) and got[1, 1][3] is None and got[1, 2][:2] == (2, 2.0) and got[3, 1][:3] == (1, 4.0, 0.0) and len(got) == 3
    assert triggered.evoked(rows.where("false")).count() == 0


def test_repeated_design_by_definition(spark):
    draw = np.random.default_rng(1)
    y = draw.normal(size=(8, 4)) + np.arange(4) * 0.5 + draw.normal(size=(8, 1))
    rows = [(s, a, float(y[s, a])) for s in range(8) for a in range(4)] + [(9, 0, 50.0), (9, 1, 50.0), (10, 2, None)]
    got = factorial.repeated_one(spark.createDataFrame(rows, "s long, a long, x double")).collect()[0]
    g = y.mean()
    between = 8 * ((y.mean(0) - g) ** 2).sum() / 3
    rest = ((y - y.mean(0) - y.mean(1)[:, None] + g) ** 2).sum() / 21
    assert (got.df, got.df_error) == (3, 21) and np.isclose(got.F, between / rest)


def test_signed_rank_by_definition(spark):
    draw = np.random.default_rng(2)
    d = np.round(draw.normal(0.3, 2.0, 300), 1)
    rows = [(k % 2, k, float(v)) for k, v in enumerate(d)] + [(0, 1000, None), (1, 1001, 0.0)]
    got = {r.key: r for r in ranks.signed_rank(spark.createDataFrame(rows, "key long, id long, d double"), 0.7).collect()}
    for key in (0, 1):
        own = d[key::2]
        own = own[own != 0]
        size = np.abs(own)
        rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        n, w = len(own), rank[own > 0].sum()
        t = np.array([(size == s).sum() for s in np.unique(size)])
        v = n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48
        assert got[key].n == n and np.isclose(got[key].w, w) and np.isclose(got[key].z, (w - n * (n + 1) / 4) / np.sqrt(v))


def test_regressions_of_all_dimensions(spark, table):
    _, _, x = table
    got = aq.a10(spark, SF).toPandas()
    design = np.column_stack([np.ones(len(x)), x[:, 32:]])
    b = np.linalg.lstsq(design, x[:, :32], rcond=None)[0]
    assert len(got) == 32 * 32
    for r in got.itertuples():
        assert np.isclose(r.beta, b[1 + r.predictor - 32, r.response], atol=1e-6)


def test_all_dimensions_of_a_mixture(spark):
    got = aq.c16_all(spark, SF).toPandas()
    assert sorted(got["dim"]) == list(range(64)) and (got["d_prime"] >= 0).all()


def test_nearest_with_ties_and_few(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKED", 3)
    monkeypatch.setattr(neighbours, "HELD", 7)
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(60, 2)))
    rows = [(k, [float(v) for v in x[k]], k % 3) for k in range(60)] + [(99, None, 1)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    got = {}
    for r in neighbours.nearest(v, v.where("vec_id % 7 = 0"), 4).collect():
        got.setdefault(r.i, []).append((r.place, r.j, r.d))
    assert set(got) == set(range(0, 60, 7))
    for i, found in got.items():
        want = sorted((round(float(np.linalg.norm(x[i] - x[j])), 6), j) for j in range(60) if j != i)[:4]
        assert [f[1] for f in sorted(found)] == [j for _, j in want] and np.allclose([f[2] for f in sorted(found)], [d for d, _ in want])
    means = {(r.item, r.type): r.d for r in neighbours.mean_by_type(v, v.where("vec_id % 7 = 0")).collect()}
    for i in range(60):
        for t in range(3):
            far = [np.linalg.norm(x[i] - x[j]) for j in range(0, 60, 7) if j % 3 == t and j != i]
            assert np.isclose(means[i, t], np.mean(far)) if far else (i, t) not in means
    one = v.where("vec_id = 0")
    assert neighbours.nearest(one, one, 3).count() == 0


def test_pairs_within_labels(spark, table):
    ids, label, x = table
    from intervalia.sources.fixtures import vectors

    got = {(r.i, r.j): (r.li, r.lj, r.d) for r in tiles.pairs(vectors(spark, SF), tiles.euclidean, size=8, within=True).collect()}
    want = {(ids[a], ids[b]) for a in range(len(ids)) for b in range(len(ids)) if ids[a] < ids[b] and label[a] == label[b]}
    assert set(got) == want
    for a, b in list(want)[:50]:
        p, q = np.flatnonzero(ids == a)[0], np.flatnonzero(ids == b)[0]
        assert got[a, b][0] == got[a, b][1] == label[p] and np.isclose(got[a, b][2], np.linalg.norm(x[p] - x[q]))


def test_template_matches(spark, table):
    from intervalia.operators import warp

    ids, label, x = table
    chosen = sorted(i for b in set(label) for i in ids[label == b][:4])
    at = [int(np.flatnonzero(ids == i)[0]) for i in chosen]
    near = np.sqrt(((x[:, None] - x[at][None]) ** 2).sum(2))
    far = warp.all_pairs(10 * x, 10 * x[at], 4)

    def ranks_of(d):
        order = sorted((round(d[i, j], 9), ids[i], j) for i in range(len(ids)) for j in range(len(at)))
        out = np.zeros(d.shape)
        place = {i: k for k, i in enumerate(ids)}
        for r, (_, i, j) in enumerate(order, 1):
            out[place[i], j] = r / len(order)
        return out

    f = np.sqrt(ranks_of(near) * ranks_of(far))
    apart = 1 - np.corrcoef(np.concatenate([f, f[at]]))[: len(ids), len(ids) :]
    types = sorted(set(label))
    means = np.stack([apart[:, [label[k] == t for k in at]].mean(1) for t in types], 1)
    got = {r.i: (r.type, r.score) for r in aq.c30(spark, SF).collect()}
    assert set(got) == set(ids.tolist())
    for k, i in enumerate(ids):
        assert got[i][0] == types[int(np.argmin(np.round(means[k], 9)))] and np.isclose(got[i][1], means[k].min(), atol=1e-7)
    best = np.array(types)[means.argmin(1)]
    for r in aq.c31(spark, SF).collect():
        own = means[label == r.label]
        assert r.type == types[int(own.mean(0).argmin())] and np.isclose(r.score, own.mean(0).min(), atol=1e-7) and np.isclose(r.agreement, (best[label == r.label] == r.type).mean())


def test_event_related_mean(spark):
    from intervalia.operators import distributions

    e = pd.read_parquet(f"{SF}/events.parquet")
    us = e["ts"].astype("datetime64[us]").astype("int64")
    e = e.assign(us=us, half=np.where(us % (30 * 86_400_000_000) < 15 * 86_400_000_000, "first", "second"))
    bought, seen = e[e["event_type"] == "purchase"], e[e["event_type"] == "view"]
    both = pd.concat([bought, seen])["us"]
    width = 6 * 3_600_000_000
    got = {(r.key, r.bin): r for r in aq.t34(spark, SF).collect()}
    assert len(got) == 16
    for key, own in bought.groupby("half"):
        for b in range(-4, 4):
            x = []
            for t, u in zip(own["us"], own["user_id"]):
                mine = seen[seen["user_id"] == u]["us"]
                x.append(((mine - t) // width == b).sum() - len(mine) * width / (both.max() - both.min()))
            x = np.array(x)
            sem = x.std(ddof=1) / np.sqrt(len(x))
            edge = distributions.t_quantile(0.975, len(x) - 1) * sem
            r = got[key, b]
            assert r.n == len(x) and np.isclose(r["mean"], x.mean()) and np.isclose(r.sem, sem)
            assert r.sign == (1 if x.mean() - edge > 0 else -1 if x.mean() + edge < 0 else 0)
