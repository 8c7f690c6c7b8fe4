"""Surrogate tests, designs, correlograms, local regression and line removal against plain forms."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from intervalia.operators import correlogram, factorial, lines, smoothing, surrogates
from intervalia.operators import distributions as dist
from intervalia.plans import inference_queries as iq

SF = "/root/testdata/sf0.001"


def pooled_t(x, y):
    n, m = len(x), len(y)
    v = (((x - x.mean()) ** 2).sum() + ((y - y.mean()) ** 2).sum()) / (n + m - 2)
    return (x.mean() - y.mean()) / math.sqrt(v * (1 / n + 1 / m))


def one_way(groups):
    all_ = np.concatenate(groups)
    between = sum(len(g) * (g.mean() - all_.mean()) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(all_) - len(groups))
    return between / within


def surrogate_rows(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["key", "id", "a", "b", "y"]))


def test_permutations_come_to_full_enumeration(spark):
    draw = np.random.default_rng(1)
    rows, want = [], {}
    for key in range(4):
        y = draw.normal(size=9) + np.repeat([0, key * 0.6], [4, 5])
        rows += [(key, i, int(i >= 4), 0, v) for i, v in enumerate(y)]
        t0 = abs(pooled_t(y[:4], y[4:]))
        ts = [abs(pooled_t(y[list(c)], np.delete(y, list(c)))) for c in itertools.combinations(range(9), 4)]
        want[key] = pooled_t(y[:4], y[4:]), np.mean(np.array(ts) >= t0 - 1e-9)
    got = {r.key: r for r in surrogates.judged(surrogates.two_sample_t(surrogates.permuted(surrogate_rows(spark, rows), 4000))).collect()}
    for key, (t, p) in want.items():
        assert abs(got[key].value - t) < 1e-9 and abs(got[key].p - p) < 0.03
        assert abs(got[key].p_theory - dist.t_two_sided(t, 7)) < 1e-9


def test_one_way_permutations(spark):
    draw = np.random.default_rng(2)
    y = draw.normal(size=7) + [0, 0, 0, 1, 1, 2, 2]
    a = [0, 0, 0, 1, 1, 2, 2]
    f0 = one_way([y[:3], y[3:5], y[5:]])
    fs = [one_way([y[list(p[:3])], y[list(p[3:5])], y[list(p[5:])]]) for p in itertools.permutations(range(7))]
    rows = surrogate_rows(spark, [(1, i, a[i], 0, v) for i, v in enumerate(y)])
    got = surrogates.judged(surrogates.one_way_f(surrogates.permuted(rows, 4000))).collect()[0]
    assert abs(got.value - f0) < 1e-9 and abs(got.p - np.mean(np.array(fs) >= f0 - 1e-9)) < 0.03
    assert abs(got.p_theory - dist.f_tail(f0, 2, 4)) < 1e-12


def test_random_comparisons(spark):
    """Without a difference p is as likely to be anywhere, by permutations, in small blocks and by bootstrap; with one it is small."""
    draw = np.random.default_rng(3)
    rows = [(k, i, i % 3, 0, v) for k in range(150) for i, v in enumerate(draw.normal(size=30))]
    rows += [(1000 + k, i, i % 3, 0, v + i % 3) for k in range(20) for i, v in enumerate(draw.normal(size=60))]
    frame = surrogate_rows(spark, rows)
    for sums in (surrogates.permuted(frame, 300), surrogates.permuted(frame, 300, block=10), surrogates.drawn(frame, 300)):
        p = {r.key: r.p for r in surrogates.judged(surrogates.one_way_f(sums)).collect()}
        flat = np.array([v for k, v in p.items() if k < 1000])
        assert len(flat) == 150 and 0.4 < flat.mean() < 0.6 and 0.01 < (flat <= 0.1).mean() < 0.2
        assert all(v < 0.05 for k, v in p.items() if k >= 1000)


def test_keys_of_one_block_are_judged_in_their_task(spark):
    """The same as from sums, for keys of one and of several blocks, constant keys, and keys of one cell; no trial of a small key is sent."""
    draw = np.random.default_rng(6)
    rows = [(k, i, i % 3, 0, v) for k in range(12) for i, v in enumerate(draw.normal(size=10 + 9 * k))]
    rows += [(50, i, i % 2, 0, 4.0) for i in range(8)] + [(51, i, 1, 0, float(i)) for i in range(8)] + [(52, i, i, 0, float(i)) for i in range(3)]
    frame = surrogate_rows(spark, rows)
    for sums, bootstrap in ((surrogates.permuted, False), (surrogates.drawn, True)):
        want = surrogates.judged(surrogates.one_way_f(sums(frame, 99, block=60))).toPandas().sort_values("key").reset_index(drop=True)
        got = surrogates.one_way_tested(frame, 99, block=60, bootstrap=bootstrap).toPandas().sort_values("key").reset_index(drop=True)
        assert len(want) == 12
        pd.testing.assert_frame_equal(got[want.columns.tolist()], want)


@pytest.mark.parametrize("query", ["q05_one", "q05_boot"])
def test_trials_of_small_keys_are_not_sent(spark, query):
    """The rows that reach the last shuffle: trials are reduced where they are made."""
    plan = getattr(iq, query)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    own = plan[: plan.index("FlatMapGroupsInPandas")]
    assert "Union" in own and "Aggregate [key" not in own


def test_two_way_permutations(spark):
    draw = np.random.default_rng(4)
    rows = [(0, i, i % 2, i // 2 % 3, v + (i % 2)) for i, v in enumerate(draw.normal(size=120))]
    got = {r.effect: r for r in surrogates.judged(surrogates.two_way_f(surrogates.permuted(surrogate_rows(spark, rows), 500, block=40))).collect()}
    assert got["a"].p < 0.01 and got["b"].p > 0.02 and (got["a"].df, got["b"].df, got["ab"].df, got["ab"].df_error) == (1, 2, 2, 114)
    for r in got.values():
        assert abs(r.p - r.p_theory) < 0.08


def test_blocks_keep_cells_and_sums(spark):
    rows = [(k % 2, i, i % 3, 0, float(i)) for k in range(2) for i in range(500)] + [(0, None, 1, 0, 1.0), (0, 7, 1, 0, math.nan)]
    sums = surrogates.permuted(surrogate_rows(spark, rows[:-2]), 20, block=64).toPandas()
    for (_, a), own in sums.groupby(["key", "a"]):
        assert own["n"].nunique() == 1 and own["s"].nunique() > 5
    for _, own in sums.groupby(["key", "trial"]):
        assert own["s"].sum() == sum(range(500)) and own["q"].sum() == sum(i * i for i in range(500))
    again = surrogates.permuted(surrogate_rows(spark, rows[:-2]).repartition(3), 20, block=64).toPandas()
    order = ["key", "trial", "a"]
    assert sums.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))


def test_surrogate_queries(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    got = {r.key: r for r in iq.q05_t(spark, SF).collect()}
    for u, own in e.groupby("user_id"):
        x, y = (own[own["event_type"] == t]["value"].to_numpy() for t in ("view", "purchase"))
        if len(x) and len(y) and len(x) + len(y) > 2:
            assert abs(got[u].value - pooled_t(x, y)) < 1e-6 and abs(got[u].p - got[u].p_theory) < 0.15
    for query in (iq.q05_one, iq.q05_boot):
        got = {r.key: r for r in query(spark, SF).collect()}
        for u, own in e.groupby("user_id"):
            groups = [g["value"].to_numpy() for _, g in own.groupby("event_type")]
            assert abs(got[u].value - one_way(groups)) < 1e-6 and abs(got[u].p - got[u].p_theory) < 0.2
    two = {r.effect: r for r in iq.q05_two(spark, SF).collect()}
    f = pd.read_parquet(f"{SF}/lineitem.parquet")
    cells = f.groupby(["l_returnflag", "l_linestatus"])["l_quantity"].agg(["count", "mean", "var"])
    h = len(cells) / (1 / cells["count"]).sum()
    rows = cells["mean"].groupby(level=0).mean()
    error = ((cells["count"] - 1) * cells["var"]).sum() / (len(f) - len(cells))
    want = h * cells.index.get_level_values(1).nunique() * ((rows - cells["mean"].mean()) ** 2).sum() / (len(rows) - 1) / error
    assert abs(two["a"].value - want) < 1e-6 and all(abs(r.p - r.p_theory) < 0.15 for r in two.values())


def design_of(f, terms):
    """Deviation-coded design of a frame, term by term."""
    coded = {c: np.array([[1.0 if v == u else -1.0 if v == levels[-1] else 0.0 for u in levels[:-1]] for v in f[c]]) for c in ("a", "b", "c") for levels in [sorted(f[c].unique())]}
    out = {}
    for t in terms:
        x = np.ones((len(f), 1))
        for c in t:
            x = np.einsum("ni,nj->nij", x, coded[c]).reshape(len(f), -1)
        out[t] = x
    return out


def rss(y, columns):
    x = np.hstack([np.ones((len(y), 1)), *columns])
    return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum(), np.linalg.matrix_rank(x)


def test_n_way(spark):
    draw = np.random.default_rng(5)
    f = pd.DataFrame({"a": draw.integers(0, 3, 200), "b": draw.choice(list("xy"), 200), "c": draw.integers(0, 4, 200)})
    f = f[~((f["a"] == 2) & (f["b"] == "y") & (f["c"] == 3))]
    f["x"] = draw.normal(size=len(f)) + f["a"] + (f["b"] == "x") * f["c"] * 0.5
    terms = [t for k in (1, 2) for t in itertools.combinations("abc", k)]
    x, y = design_of(f, terms), f["x"].to_numpy()
    whole, rank = rss(y, x.values())
    got = {r.effect: r for r in factorial.n_way(spark.createDataFrame(f), ["a", "b", "c"]).collect()}
    assert list(got) == [":".join(t) for t in terms]
    for k, t in enumerate(terms):
        r = got[":".join(t)]
        rest, others = rss(y, [x[u] for u in terms if u != t])
        df, left = rank - others, len(f) - rank
        assert (r.df, r.df_error) == (df, left)
        assert np.isclose(r.ss_marginal, rest - whole) and np.isclose(r.ss_sequential, rss(y, [x[u] for u in terms[:k]])[0] - rss(y, [x[u] for u in terms[: k + 1]])[0])
        assert np.isclose(r.F, (rest - whole) / df / (whole / left)) and np.isclose(r.p, dist.f_tail(r.F, df, left))
    assert factorial.n_way(spark.createDataFrame(f).where("false"), ["a", "b", "c"]).count() == 0


def test_n_way_is_unweighted_where_cells_are_even(spark):
    draw = np.random.default_rng(6)
    f = pd.DataFrame([(a, b, c, draw.normal() + a * c) for a in range(2) for b in range(3) for c in range(2) for _ in range(5)], columns=["a", "b", "c", "x"])
    df = spark.createDataFrame(f)
    one = {r.effect: r for r in factorial.n_way(df, ["a", "b", "c"], order=3).collect()}
    two = {r.effect: r for r in factorial.unweighted(df, ["a", "b", "c"]).collect()}
    assert set(one) == set(two)
    for e, r in one.items():
        assert np.isclose(r.ss_marginal, two[e].ss) and np.isclose(r.ss_sequential, two[e].ss) and np.isclose(r.F, two[e].F) and (r.df, r.df_error) == (two[e].df, two[e].df_error)


def test_n_way_query(spark):
    f = pd.read_parquet(f"{SF}/lineitem.parquet")
    f = f.rename(columns={"l_returnflag": "a", "l_linestatus": "b", "l_linenumber": "c"})
    terms = [t for k in (1, 2) for t in itertools.combinations("abc", k)]
    x, y = design_of(f, terms), f["l_quantity"].to_numpy(float)
    whole, rank = rss(y, x.values())
    for t, r in zip(terms, iq.q04_n(spark, SF).collect()):
        rest, others = rss(y, [x[u] for u in terms if u != t])
        assert np.isclose(r.ss_marginal, rest - whole, rtol=1e-6) and r.df == rank - others and r.df_error == len(f) - rank


def test_correlogram_against_shuffles(spark):
    """Events that follow others at a fixed lag stand out; what comes of both being frequent at the same hour does not."""
    draw = np.random.default_rng(7)
    a, b = [], []
    for s in range(3):
        for r in range(40):
            t = np.sort(draw.integers(0, 1_000_000, 12)) + r * 1_000_000
            a += [(s, int(v)) for v in t]
            b += [(s, int(v) + 20_500) for v in t if v % 1_000_000 < 900_000 and s < 2] + [(s, int(v)) for v in draw.integers(0, 1_000_000, 6) + r * 1_000_000]
    frames = [spark.createDataFrame(x, "series long, t_us long") for x in (a, b)]
    got = correlogram.against_shuffles(*frames, 50_000, 1_000, 1_000_000).toPandas()
    for s in range(3):
        own = got[got["series"] == s].set_index("bin")
        pairs = [q - p for u, p in a if u == s for v, q in b if v == s and p // 1_000_000 == q // 1_000_000 and abs(q - p) <= 50_000]
        counted = pd.Series([p // 1_000 for p in pairs]).value_counts()
        assert own["pairs"].sum() == len(pairs) and (own["pairs"].reindex(counted.index) == counted).all()
        assert (own.loc[20, "z"] > 20) == (s < 2)
        assert np.abs(own[(own.index != 20)]["excess"].mean()) < 1


def test_shuffles_move_every_trial(spark):
    b = spark.createDataFrame([(s, t) for s in range(4) for t in range(s + 1)], "series long, trial long")
    got = correlogram.shuffled_trials(b, 5).toPandas()
    assert set(got["series"]) == {1, 2, 3} and (got["trial"] != got["met"]).all()
    for (s, _), own in got.groupby(["series", "shuffle"]):
        assert sorted(own["trial"]) == sorted(own["met"]) == list(range(s + 1))


def test_correlogram_query(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    us = e["ts"].astype("datetime64[us]").astype("int64")
    e = e.assign(trial=us // iq.CROSS[2], t=us % iq.CROSS[2])
    got = iq.q17_shuffled(spark, SF).toPandas()
    shuffles = correlogram.shuffled_trials(spark.createDataFrame(e[e["event_type"] == "purchase"][["user_id", "trial"]].rename(columns={"user_id": "series"}).drop_duplicates()), 20).toPandas()
    u = int(got["series"].iloc[0])
    own = e[e["user_id"] == u]
    a, b = (own[own["event_type"] == k] for k in ("view", "purchase"))
    total = {}
    for _, one in shuffles[shuffles["series"] == u].groupby("shuffle"):
        met = dict(zip(one["trial"], one["met"]))
        for tb, trial in zip(b["t"], b["trial"]):
            for ta in a[a["trial"] == met[trial]]["t"]:
                if abs(tb - ta) <= iq.CROSS[0]:
                    k = (tb - ta) // iq.CROSS[1]
                    total[k] = total.get(k, 0) + 1
    rows = got[got["series"] == u].set_index("bin")["expected"]
    assert {k: round(v * 20) for k, v in rows.items() if v} == total


def plain_local(x, y, at, k, degree=2):
    far = np.abs(x - at)
    h = np.sort(far)[k - 1]
    w = np.where(far < h, (1 - (far / h) ** 3) ** 3, 0.0) if h > 0 else (far == 0).astype(float)
    scaled = (x - at) / (h or 1)
    basis = scaled[:, None] ** np.arange(degree + 1)
    inverse = np.linalg.pinv(basis.T @ (w[:, None] * basis), rcond=1e-10)
    weights = inverse[0] @ (basis.T * w)
    return float(weights @ y), float(inverse[0, 0]), float(weights @ weights)


def test_local_regression(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    e["x"] = e["ts"].astype("datetime64[us]").astype("int64") / iq.DAY_US
    got = iq.local(spark, SF).toPandas()
    gcv = iq.l02(spark, SF).toPandas()
    best = iq.l01(spark, SF).toPandas()
    assert len(best) == len(e)
    for u, own in e.groupby("user_id"):
        x, y, ids = own["x"].to_numpy(), own["value"].to_numpy(), own["event_id"].to_numpy()
        scores, errors, norms = {}, {}, {}
        for k in iq.NEIGHBOURS:
            plain = [plain_local(x, y, v, min(k, len(x))) for v in x]
            rows = got[(got["series"] == u) & (got["k"] == k)].set_index("id").loc[ids]
            assert np.allclose(rows["fit"], [p[0] for p in plain], atol=1e-4) and np.allclose(rows["leverage"], [p[1] for p in plain], atol=1e-4)
            trace, res = sum(p[1] for p in plain), sum((a - p[0]) ** 2 for a, p in zip(y, plain))
            free = len(x) - 2 * trace + sum(p[2] for p in plain)
            errors[k] = math.sqrt(res / free) if free > 1e-6 else math.nan
            norms[k] = np.array([p[2] for p in plain])
            scores[k] = len(x) * res / (len(x) - trace) ** 2 if len(x) - trace > 1e-6 else math.inf
            own_gcv = gcv[(gcv["series"] == u) & (gcv["k"] == k)].iloc[0]
            if math.isfinite(scores[k]):
                assert np.isclose(own_gcv["gcv"], scores[k], rtol=1e-3) and np.isclose(own_gcv["trace"], trace, rtol=1e-3) and np.isclose(own_gcv["sigma"], errors[k], rtol=1e-3)
                assert np.isclose(own_gcv["aic"], len(x) * math.log(res / len(x)) + 2 * trace, rtol=1e-3)
                if max(p[1] for p in plain) < 0.9:
                    assert np.isclose(own_gcv["lcv"], sum(((a - p[0]) / (1 - p[1])) ** 2 for a, p in zip(y, plain)), rtol=1e-3)
        finite = {k: v for k, v in scores.items() if math.isfinite(v)}
        chosen = min(finite, key=lambda k: (finite[k], k)) if finite else max(scores)
        rows = best[best["series"] == u].set_index("id").loc[ids]
        assert set(rows["k"]) == {chosen}
        if math.isfinite(errors[chosen]):
            assert np.allclose(rows["upper"] - rows["lower"], 2 * 1.959963984540054 * errors[chosen] * np.sqrt(norms[chosen]), rtol=1e-3, atol=1e-3)


def test_local_regression_across_buckets(spark):
    """A series longer than a bucket, with ties, nulls and a series of one point."""
    draw = np.random.default_rng(8)
    x = np.sort(np.round(draw.uniform(0, 40, 1500), 1))
    y = np.sin(x / 3) + 0.1 * draw.normal(size=1500)
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(2, 1, 5.0, 3.0), (3, 1, None, 1.0), (None, 1, 1.0, 1.0), (4, 1, 2.0, 1.0), (4, 2, 2.0, 3.0)]
    fits = smoothing.regressions(spark.createDataFrame(rows, "series long, id long, x double, y double"), [60], 7.0).toPandas()
    own = fits[fits["series"] == 1].sort_values("id")
    assert len(own) == 1500
    for i in range(0, 1500, 37):
        f, h, _ = plain_local(x, y, x[i], 60)
        assert abs(own["fit"].iloc[i] - f) < 1e-6 and abs(own["leverage"].iloc[i] - h) < 1e-6
    assert np.abs(own["fit"] - np.sin(x / 3)).max() < 0.2
    assert fits[fits["series"] == 2]["fit"].tolist() == [3.0] and np.allclose(fits[fits["series"] == 4]["fit"], 2.0) and set(fits["series"]) == {1, 2, 4}


def test_local_predictions(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    e["x"] = e["ts"].astype("datetime64[us]").astype("int64") / iq.DAY_US
    got = iq.l03(spark, SF).toPandas()
    for u, own in e.groupby("user_id"):
        own = own.sort_values(["x", "event_id"])
        x, y = own["x"].to_numpy(), own["value"].to_numpy()
        rows = got[got["series"] == u].sort_values("id")
        assert rows["id"].tolist() == list(range(math.floor(x.min()), math.floor(x.max()) + 1))
        assert np.allclose(rows["fit"], [plain_local(x, y, v, min(24, len(x)))[0] for v in rows["x"]], atol=1e-4)


def test_predictions_across_buckets(spark):
    draw = np.random.default_rng(10)
    x = np.sort(draw.uniform(0, 40, 1300))
    y = np.cos(x / 2)
    rows = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "series long, id long, x double, y double")
    at = [-1.0, 0.0, float(x[511]), float(x[512]), 20.0, 20.0, 39.9, 41.0]
    asked = spark.createDataFrame([(1, i, v) for i, v in enumerate(at)] + [(2, 0, 1.0), (1, 99, None)], "series long, id long, x double")
    got = {(r.series, r.id): r.fit for r in smoothing.predicted(rows, asked, 50, 3.0).collect()}
    assert set(got) == {*((1, i) for i in range(8)), (2, 0)} and got[2, 0] is None
    for i, v in enumerate(at):
        assert abs(got[1, i] - plain_local(x, y, v, 50)[0]) < 1e-6


def test_planted_lines_vanish():
    draw = np.random.default_rng(9)
    t = np.arange(512) / 1000
    noise = draw.normal(size=512)
    for hz, size in (((60.0,), 3.0), ((50.0, 120.0, 301.5), 2.0)):
        x = noise + sum(size * np.sin(2 * np.pi * h * t + h) for h in hz)
        total, seen = lines.Lines(512, 1000.0).fitted(x)
        assert all(min(abs(f - h) for f, _ in seen) < 1.5 for h in hz)
        assert np.sqrt(np.mean((x - total - noise) ** 2)) < 0.45
    alone = [len(lines.Lines(256, 1000.0).fitted(draw.normal(size=256))[1]) for _ in range(200)]
    assert np.mean([a > 0 for a in alone]) < 0.2


def test_line_removal_query(spark):
    clean = {r.sid: np.array(r.x) for r in iq.signals(spark, SF).collect()}
    hum = {r.sid: np.array(r.x) for r in iq.with_hum(spark, SF).collect()}
    got = iq.d25(spark, SF).toPandas().sort_values(["sid", "k"])
    assert len(got) == sum(map(len, clean.values()))
    test, weight = lines.Lines(256, iq.FS), lines.fade(256, 128)
    for sid, own in got.groupby("sid"):
        x, n = hum[sid], len(hum[sid])
        if n < 256:
            assert np.allclose(own["y"], x)
            continue
        total, weights = np.zeros(n), np.zeros(n)
        for start in sorted({*range(0, n - 255, 128), n - 256}):
            total[start : start + 256] += weight * test.fitted(x[start : start + 256])[0]
            weights[start : start + 256] += weight
        assert np.allclose(own["y"], x - total / weights)
        before, after = (np.sqrt(np.mean((v - clean[sid]) ** 2)) for v in (x, own["y"].to_numpy()))
        assert after < 0.25 * before


def test_lines_query(spark):
    x = {r.sid: np.array(r.x) for r in iq.signals(spark, SF).collect()}
    test = lines.Lines(256, iq.FS)
    want = sorted((sid, s, round(f, 6)) for sid, v in x.items() if len(v) >= 256 for s in sorted({*range(0, len(v) - 255, 128), len(v) - 256}) for f, _ in test.fitted(v[s : s + 256])[1])
    assert sorted((r.sid, r.start, round(r.hz, 6)) for r in iq.d26(spark, SF).collect()) == want
