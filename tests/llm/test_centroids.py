"""Centroid clustering against plain distances."""

import hashlib
import math
import random

import numpy as np
import oracle
import pytest

pytest.importorskip("intervalia.llm")

from intervalia.llm import centroid_clusters as cc  # noqa: E402
from intervalia.llm import queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string, h string"


def plain(rows, k=16, rounds=3, size=64, scale=64, seed=1):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v) and all(abs(math.floor(scale * x)) <= cc.LARGEST for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1])
    z = [v for _, v in sorted(kept, key=hashed)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(z)), key=lambda c: (far(v, z[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for c in range(len(z)):
            members = [v for (_, v), o in zip(kept, of) if o == c]
            if members:
                z[c] = [sum(x) // len(members) for x in zip(*members)] if c in of else z[c]
    of = [nearest(v) for _, v in kept]
    d = [far(v, z[o]) for (_, v), o in zip(kept, of)]
    inertia = [sum(x for x, o in zip(d, of) if o == c) for c in range(len(z))]
    fits = lambda n: n if n < 2**63 else None
    return sorted([(i, o, x, fits(inertia[o]), fits(sum(d)), hashlib.sha256(",".join(map(str, z[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, of, d)], key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, cc.cluster(df, **options).collect()), key=str)


def fixture(n, groups, seed, spread=0.3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(groups)]
    rows = [(k, [x + r.gauss(0, spread) for x in centres[k % groups]]) for k in range(n)]
    hot = list(rows[0][1])
    rows += [(n + k, hot) for k in range(n // 3)]
    return rows


def odd():
    v = [0.5] * 64
    return [(1, None), (2, []), (3, v[:63]), (4, [*v, 0.5]), (5, [None, *v[1:]]), (6, [math.nan, *v[1:]]), (7, [math.inf, *v[1:]]), (8, [-math.inf, *v[1:]]), (9, [1e300, *v[1:]]), (None, v), (None, v), (10, v), (10, v), (10, [-0.001] * 64), (11, [2.0**20] * 64), (12, [-(2.0**20)] * 64), (13, [2.0**21] * 64)]


@pytest.mark.parametrize("rows", [fixture(150, 5, 1), fixture(60, 60, 2), odd(), odd() + fixture(80, 3, 4), fixture(9, 9, 3)[:5]])
def test_same_as_plain(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_small_trees(spark):
    rows = fixture(200, 4, 5)
    assert got(spark, rows, block=32, leaf=4, k=5, rounds=4, seed=7) == plain(rows, k=5, rounds=4, seed=7)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(x) for x in ([k % 3] * 64)]) for k in range(40)]
    assert got(spark, rows) == plain(rows)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cc.cluster(none).count() == 0
    assert cc.cluster(spark.createDataFrame([(1, None, 0, 0, "", "")], SCHEMA)).count() == 0


def test_balls_are_counted_whole():
    """Well-parted groups are settled by balls, and every member is in one range of one descent."""
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.integers(-20, 20, (1000, 8)) + 1000 * c for c in range(4)])
    order, radii, sums = cc.build(x, 16)
    assert sorted(order) == list(range(4000))
    z = np.array([[1000 * c] * 8 for c in range(4)])
    found = list(cc.descend(4000, radii, sums, z, 16))
    assert len(found) < 64 and all(len(may) == 1 for *_, may in found)
    covered = np.zeros(4000, int)
    for node, a, b, may in found:
        covered[a:b] += 1
        assert (cc.exact_distances(x[order[a:b]], z).argmin(1) == may[0]).all()
        assert (sums[node] == cc.sums_of(x[order[a:b]])).all()
    assert (covered == 1).all()


def test_distances_beyond_doubles():
    x, z = np.array([[cc.LARGEST] * 64, [-cc.LARGEST] * 64]), np.array([[-cc.LARGEST] * 64, [cc.LARGEST - 1] * 64])
    assert cc.exact_distances(x, z).tolist() == [[64 * (2 * cc.LARGEST) ** 2, 64], [0, 64 * (2 * cc.LARGEST - 1) ** 2]]


def test_same_as_sql(spark):
    assert oracle.differences(spark, "op11", queries.op11_centroid_clusters, cc.sql(), "/root/testdata/sf0.001") == ""
