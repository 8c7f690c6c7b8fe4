"""What failed on larger or odder tables, on small ones."""

import math

import numpy as np

from intervalia.operators import measures


def frame(spark, v, labels=None):
    """vec_id, v, label of the rows of an array."""
    labels = np.zeros(len(v), int) if labels is None else labels
    return spark.createDataFrame([(i, [float(y) for y in x], int(k)) for i, (x, k) in enumerate(zip(v, labels))], "vec_id long, v array<double>, label int")


def test_reductions_of_constant_series(spark):
    rows = [(1, k, 2.5) for k in range(1, 5)] + [(2, 1, 3.0)] + [(3, k, float(k * k)) for k in range(1, 5)]
    got = {r["vec_id"]: r for r in measures.reductions(spark.createDataFrame(rows, "vec_id long, k int, x double")).collect()}
    assert got[1]["lintrend"] == got[2]["lintrend"] == 0.0 and got[1]["mean"] == 2.5
    assert math.isclose(got[3]["lintrend"], np.corrcoef([1, 2, 3, 4], [1, 4, 9, 16])[0, 1])


def test_linkage_in_rounds(spark, monkeypatch):
    """Blocks above MOST by rounds give the trees and cuts of one task, copies among them."""
    from intervalia.operators import linkage

    draw = np.random.default_rng(5)
    v = draw.normal(size=(150, 6))
    v[40:44] = v[7]
    v[90] = v[12]
    rows = frame(spark, v, np.arange(150) % 5 // 4)
    own = [np.flatnonzero(np.arange(150) % 5 // 4 == k) for k in (0, 1)]
    for rule in ("complete", "weighted", "average", "ward"):
        want = {(b, int(i), k): c for b, ids in enumerate(own) for k in (2, 5) for i, c in zip(ids, linkage.cut(linkage.merges(linkage.tiles.euclidean(v[ids], v[ids]), rule), len(ids), k))}
        heights = {b: linkage.merges(linkage.tiles.euclidean(v[ids], v[ids]), rule)[:, 2] for b, ids in enumerate(own)}
        with monkeypatch.context() as m:
            m.setattr(linkage, "MOST", 100)
            m.setattr(linkage, "HANDOFF", 85)
            got = {(r["block"], r["vec_id"], r["k"]): r["cluster"] for r in linkage.cuts(rows, [2, 5], "label", rule).collect()}
            assert got == want, rule
            if rule == "average":
                trees = linkage.trees(rows, "label", rule).toPandas()
                for b, ids in enumerate(own):
                    t = trees[trees["block"] == b].sort_values("step")
                    assert t["step"].tolist() == list(range(len(ids) - 1)) and np.allclose(t["height"], heights[b])
                    tree = t[["a", "b", "height"]].to_numpy()
                    assert (tree[:, 1] < len(ids) + np.arange(len(ids) - 1)).all()
                    assert [linkage.cut(tree, len(ids), 5).tolist()] == [[want[b, int(i), 5] for i in ids]]
            if rule == "complete":
                firsts = linkage.narrowed(rows, "label").where("block = 0").count()
                assert firsts == math.ceil(math.sqrt(len(own[0])))


def test_sums_and_medians_without_pairs(spark, monkeypatch):
    """Sums of distances by label, medians and nearest, over several tiles and strips, with copies and a label of one."""
    from intervalia.operators import neighbours, tiles

    draw = np.random.default_rng(8)
    v = draw.normal(size=(300, 4))
    v[50:60] = v[3]
    labels = np.arange(300) % 3
    labels[299] = 9
    monkeypatch.setattr(tiles, "COARSE", 100)
    monkeypatch.setattr(tiles, "SIZE", 50)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    rows = frame(spark, v, labels)
    for within in (False, True):
        got = {(r["i"], r["lj"]): (r["n"], r["s"], r["q"]) for r in tiles.sums(rows, within=within).collect()}
        want = {}
        for i in range(300):
            for k in {int(labels[i])} if within else set(labels.tolist()):
                own = np.flatnonzero((labels == k) & (np.arange(300) != i))
                if len(own):
                    want[i, k] = len(own), d[i, own].sum(), (d[i, own] ** 2).sum()
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    got = {(r["i"], r["lj"]): r["m"] for r in neighbours.median_by_label(rows, rows).collect()}
    want = {(i, int(k)): np.median(d[i, (labels == k) & (np.arange(300) != i)]) for i in range(300) for k in set(labels.tolist()) if k != labels[i] or k != 9}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    got = sorted((r["i"], r["place"], r["j"]) for r in neighbours.nearest(rows, rows, 5).collect())
    near = np.round(d, 6)
    np.fill_diagonal(near, np.inf)
    assert got == [(i, p + 1, int(j)) for i in range(300) for p, j in enumerate(np.lexsort((np.arange(300), near[i]))[:5])]


def test_correlation_distances_in_blocks(spark, monkeypatch):
    """Several blocks of rows and of columns, with copies."""
    from intervalia.operators import tiles

    draw = np.random.default_rng(9)
    v = draw.normal(size=(90, 5))
    v[80:84] = v[2]
    monkeypatch.setattr(tiles, "SIZE", 20)
    monkeypatch.setattr(tiles, "COARSE", 40)
    got = tiles.correlation_distances(frame(spark, v), 30).toPandas().sort_values(["i", "j"])
    i, j = np.triu_indices(90, 1)
    want = 1 - np.corrcoef(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)))
    assert got["i"].tolist() == i.tolist() and got["j"].tolist() == j.tolist() and np.allclose(got["d"], want[i, j], atol=1e-9)


def test_pairs_are_not_broadcast(spark):
    """What Python functions give counts as small in plans, but is not."""
    from intervalia.plans import registry

    plan = lambda name: registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan("p18_distance_panel")
    m15 = plan("m15_spike_field_coherogram")
    assert m15.count("SortMergeJoin") >= 2 and "LeftOuter, BuildRight" not in m15


def test_blocks_grow_with_the_table(spark):
    """All pairs once, by pieces of larger blocks."""
    from intervalia.operators import tiles

    v = np.random.default_rng(2).normal(size=(400, 3))
    got = tiles.pairs(frame(spark, v), tiles.euclidean, size=8)
    i, j = np.triu_indices(400, 1)
    rows = got.toPandas().sort_values(["i", "j"])
    assert rows["i"].tolist() == i.tolist() and rows["j"].tolist() == j.tolist() and np.allclose(rows["d"], np.linalg.norm(v[i] - v[j], axis=1))


def test_warps_stay_near_the_processor():
    """Frames of many pairs are not spread out at once, and distances are those of plain sums."""
    import tracemalloc

    from intervalia.operators import warp

    a, b = np.random.default_rng(3).normal(size=(2, 4096, 13 * 29))
    tracemalloc.start()
    got = warp.each_pair(a, b, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
    for k in (0, 4095):
        x, y = a[k].reshape(13, 29), b[k].reshape(13, 29)
        best = np.full((29, 29), np.inf)
        for i in range(29):
            for j in range(max(0, i - warp.MARGIN), min(29, i + warp.MARGIN)):
                before = [best[i - 1, j - 1] if i and j else np.inf, best[i - 1, j] + 1 if i and j else np.inf, best[i, j - 1] + 1 if j else np.inf]
                best[i, j] = ((x[:, i] - y[:, j]) ** 2).sum() + (min(before) if i or j else 0.0)
        assert np.isclose(got[k], np.sqrt(best[28, 28]))


def test_percentiles_without_pairs(spark, monkeypatch):
    """Exact percentiles within labels, with copies, a label of one and one of no number; no row for a pair, which an aggregate held one by one."""
    from intervalia.operators import percentiles, tiles
    from intervalia.plans import registry

    v = np.random.default_rng(4).normal(size=(200, 5))
    v[100:140] = v[3]
    labels = np.where(np.arange(200) < 150, np.arange(200) % 2, 2)
    labels[199] = 3
    v[198, 0] = np.nan
    monkeypatch.setattr(tiles, "SIZE", 20)
    monkeypatch.setattr(tiles, "STRIP", 7)
    rows = frame(spark, v, labels).union(spark.createDataFrame([(300, None, 0), (301, [0.0] * 5, None)], "vec_id long, v array<double>, label int"))
    for share in (0.0, 0.31, 0.9, 1.0):
        got = {r["label"]: (r["value"], r["pairs"]) for r in percentiles.within_labels(rows, share).collect()}
        want = {}
        for k in (0, 1, 2):
            x = v[labels == k]
            i, j = np.triu_indices(len(x), 1)
            d = np.sort(tiles.euclidean(x, x)[i, j])
            pairs, d = len(d), d[~np.isnan(d)]
            place = share * (len(d) - 1)
            want[k] = (d[int(place)] + (place - int(place)) * (d[math.ceil(place)] - d[int(place)]), pairs)
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and np.isclose(got[k][0], want[k][0], rtol=1e-12) for k in want)
    plan = registry.queries()["k05_adapted_threshold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "percentile(" not in plan


def test_offsets_form_what_is_asked_for(spark, monkeypatch):
    """Every set of reductions, with copies, silence and several pieces, is that of plain forms, and pairs within labels alone are formed for p11."""
    from intervalia.operators import offsets, tiles
    from intervalia.plans import comparison_queries, registry

    draw = np.random.default_rng(12)
    v = draw.normal(size=(60, 64))
    v[20], v[21], v[22, 40:] = v[3], 0, 0
    labels = np.arange(60) % 4
    want = {}
    with np.errstate(invalid="ignore"):
        for i in range(60):
            for j in range(60):
                w = np.stack([v[j][o : o + 32] for o in range(33)])
                c = w @ v[i][:32] / np.sqrt((v[i][:32] @ v[i][:32]) * (w * w).sum(1))
                want[i, j] = {"distance": np.sqrt(((w - v[i][:32]) ** 2).sum(1)).min(), "mean": c.mean(), "most": c.max(), "least": c.min(), "median": np.median(c), "rms": np.sqrt((c * c).mean())}
    monkeypatch.setattr(offsets, "AT_ONCE", 100)
    monkeypatch.setattr(tiles, "SIZE", 25)
    rows = frame(spark, v, labels)
    for wanted in (("distance",), ("mean",), ("most",), ("median", "mean"), offsets.REDUCTIONS):
        got = offsets.slid(rows, wanted=wanted).toPandas().set_index(["i", "j"])
        assert len(got) == 3600 and tuple(got.columns) == wanted
        assert all(np.allclose(got[r].astype(float), [want[k][r] for k in got.index], atol=1e-9, equal_nan=True) for r in wanted)
    assert offsets.rounded(np.array([-0.0078125, 0.0078125, -1e-9]), 6).tolist() == [-0.007813, 0.007813, 0.0]
    monkeypatch.setattr(comparison_queries, "vectors", lambda spark, d: rows)
    x = registry.queries()["p11_within_parent"](spark, "")
    got = {(r["i"], r["j"]): (r["label"], r["best"]) for r in x.collect()}
    assert got.keys() == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 4 == j % 4}
    assert all(label == i % 4 and np.isclose(np.nan if best is None else best, want[i, j]["most"], atol=1e-6, equal_nan=True) for (i, j), (label, best) in got.items())
    plan = x._jdf.queryExecution().sparkPlan().toString()
    assert "li#" not in plan and "lj#" not in plan


def test_ragged_warps_stay_near_the_processor():
    """Pairs of series of several lengths are not laid side by side all at once; of equally long ones that of the lower key leads."""
    import tracemalloc

    from intervalia.operators import warp

    draw = np.random.default_rng(13)
    keys = draw.permutation(160).tolist()
    series = [(k, draw.normal(size=(4, 16 - k % 3))) for k in keys]
    a, b = series[:80], series[80:]
    tracemalloc.start()
    got = warp.ragged(a, b, False, 0.001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3e6
    both = np.concatenate([got.to_numpy(), *[warp.ragged(x, x, True, 0.001).to_numpy() for x in (a, b)]])
    of = dict(series)
    assert len(both) == 160 * 159 // 2 == len({(i, j) for i, j, _ in both})
    for i, j, d in both[::97]:
        x, y = sorted((of[i], of[j]), key=lambda s: s.shape[1])
        assert i < j and np.isclose(d, warp.warp_block(x[None], y[None])[0] / ((x.shape[1] + y.shape[1]) / 2000))
