"""Fitted models against brute force."""

import numpy as np

from intervalia.operators import models
from intervalia.plans import registry
from intervalia.sources.fixtures import vectors

SF = "/root/testdata/sf0.001"


def matrix(spark):
    rows = sorted(vectors(spark, SF).select("vec_id", "v").collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows])


def test_principal_components(spark):
    ids, v = matrix(spark)
    z = (v - v.mean(0)) / v.std(0, ddof=1)
    _, s, t = np.linalg.svd(z, full_matrices=False)
    keep = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.995) + 1)
    got = sorted(registry.queries()["a07_principal_components"](spark, SF).collect())
    assert [r[0] for r in got] == ids
    assert np.allclose(np.abs([r[1] for r in got]), np.abs((z @ t.T)[:, :keep]), atol=1e-6)


def test_codebook(spark):
    ids, v = matrix(spark)
    got = sorted(registry.queries()["c17_codebook"](spark, SF).collect())
    assert [r[0] for r in got] == ids
    cluster = np.array([r[1] for r in got])
    assert set(cluster) <= set(range(8))
    centres = {c: v[cluster == c].mean(0) for c in set(cluster)}
    d = np.array([np.linalg.norm(x - centres[c]) for x, c in zip(v, cluster)])
    assert np.allclose(d, [r[2] for r in got], atol=0.1)


def test_empty(spark):
    none = vectors(spark, SF).where("false")
    assert models.principal(none).count() == 0
    assert models.codebook(none).count() == 0


def test_halves(spark):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(200, 3))
    v[100:, 1] += 20
    v[:, 2] = 4.0
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, v array<double>")
    parts, dims = models.halves(rows, [0, 1, 2])
    got = [r[1] for r in sorted(parts.collect())]
    assert len(set(got[:100])) == len(set(got[100:])) == 1 and got[0] != got[100]
    by = dict(dims.collect())
    assert sorted(by) == [0, 1]
    means, spread = np.abs(v[:100].mean(0) - v[100:].mean(0)), np.sqrt(v[:100].var(0) + v[100:].var(0))
    assert np.allclose([by[0], by[1]], means[:2] / spread[:2], rtol=0.02, atol=0.01)
    for out in models.halves(rows.where("false"), [0, 1]) + models.halves(rows, [2]):
        assert out.count() == 0


def test_halves_of_the_tables(spark):
    ids, _ = matrix(spark)
    got = sorted(registry.queries()["c16_split_in_two"](spark, SF).collect())
    assert [r[0] for r in got] == ids and {r[1] for r in got} <= {0, 1} and all(0.5 <= r[2] <= 1 + 1e-9 for r in got)
