"""Point-process spectra, coherence and errors: rows of the queries against direct sums over every event."""

import math

import numpy as np
import pandas as pd
import pytest

from intervalia.operators import distributions as dist
from intervalia.operators import spectra
from intervalia.operators.dsp import slepian
from intervalia.plans import registry
from intervalia.plans import spectral_queries as sq

SF = "/root/testdata/sf0.001"
N, RATE, K = 144, 24.0, 5
HZ = np.arange(129) * RATE / 256
HZ = HZ[HZ <= 4]
TAPERS = slepian(N, 3.0, K) * math.sqrt(RATE)
MIDDLES = (np.arange(N) + 0.5) / RATE


def events():
    e = pd.read_parquet(f"{SF}/events.parquet")
    us = e["ts"].astype("datetime64[us]").astype("int64")
    return e.assign(trial=us // sq.TRIAL_US, t=(us % sq.TRIAL_US) / 86_400_000_000, value=(e["value"] * 60e6).round() / 60e6)


def direct(t, w):
    """Transform (frequencies, tapers) of times and weights, one by one."""
    out = np.zeros((len(HZ), K), complex)
    for a, b in zip(t, w):
        for k in range(K):
            out[:, k] += b * np.interp(a, MIDDLES, TAPERS[k]) * np.exp(-2j * np.pi * HZ * a)
    return out


def views_of(e, user):
    """Transforms by trial, less the mean rate."""
    own = e[(e["user_id"] == user) & (e["event_type"] == "view")]
    level = direct(MIDDLES, np.ones(N))
    level = sum(np.exp(-2j * np.pi * HZ * m)[:, None] * TAPERS[:, j][None] for j, m in enumerate(MIDDLES))
    return {int(trial): (direct(x["t"], np.ones(len(x))) - level * len(x) / N, len(x)) for trial, x in own.groupby("trial")}


def spending_of(e, user):
    own = e[(e["user_id"] == user) & (e["event_type"] == "purchase")]
    out = {}
    for trial, x in own.groupby("trial"):
        hour = np.floor(x["t"] * RATE)
        sums = x.groupby(hour)["value"].sum()
        out[int(trial)] = direct((sums.index.to_numpy() + 0.5) / RATE, sums.to_numpy())
    return out


def stacked(j):
    return np.concatenate(list(j), 1)


def jackknife(j):
    """Chi-squared-free limits of a spectrum by leaving one column out."""
    p = np.abs(j) ** 2
    m = p.shape[1]
    left = np.stack([np.delete(p, k, 1).mean(1) for k in range(m)])
    return p.mean(1), math.sqrt(m - 1) * np.log(left).std(0), m


def test_point_spectrum(spark):
    e = events()
    got = sq.m05(spark, SF).toPandas()
    users = sorted(e[e["event_type"] == "view"]["user_id"].unique())
    assert sorted(got["series"].unique()) == users and len(got) == len(users) * len(HZ)
    for u in users:
        rows = got[got["series"] == u].sort_values("hz")
        found = views_of(e, u)
        count = sum(n for _, n in found.values())
        s, sd, m = jackknife(stacked(j for j, _ in found.values()))
        dof = math.floor(1 / (1 / (2 * m) + 1 / (2 * count)))
        assert np.allclose(rows["hz"], HZ) and np.allclose(rows["power"], s)
        assert np.allclose(rows["rate"], count / (len(found) * 6)) and (rows["dof"] == dof).all()
        assert np.allclose(rows["lower"], dof * s / dist.chi2_quantile(0.975, dof)) and np.allclose(rows["upper"], dof * s / dist.chi2_quantile(0.025, dof))
        spread = np.exp(dist.t_quantile(0.975, m - 1) * sd)
        assert np.allclose(rows["jack_lower"], s / spread) and np.allclose(rows["jack_upper"], s * spread)


def test_spectrogram(spark):
    e = events()
    got = sq.m07(spark, SF).toPandas()
    u = int(got["series"].iloc[0])
    found = views_of(e, u)
    own = got[got["series"] == u]
    assert sorted(own["trial"].unique()) == sorted(found)
    for trial, (j, n) in found.items():
        rows = own[own["trial"] == trial].sort_values("hz")
        assert np.allclose(rows["power"], (np.abs(j) ** 2).mean(1)) and np.allclose(rows["rate"], n / 6)


def pair_of(x, y):
    xx, yy, xy = (np.abs(x) ** 2), (np.abs(y) ** 2), np.conj(x) * y
    of = lambda keep: xy[:, keep].mean(1) / np.sqrt(xx[:, keep].mean(1) * yy[:, keep].mean(1))
    m = x.shape[1]
    return of(np.arange(m)), [of(np.delete(np.arange(m), k)) for k in range(m)], m


def test_spike_field_coherence(spark):
    e = events()
    got = sq.m06(spark, SF).toPandas()
    users = sorted(e[e["event_type"] == "purchase"]["user_id"].unique())
    assert sorted(got["series"].unique()) == users and len(got) == len(users) * len(HZ)
    compared = 0
    for u in users:
        rows = got[got["series"] == u].sort_values("hz")
        spent, viewed = spending_of(e, u), views_of(e, u)
        count = sum(viewed[t][1] for t in spent if t in viewed)
        x = stacked(spent.values())
        y = stacked(viewed[t][0] if t in viewed else np.zeros((len(HZ), K)) for t in spent)
        if not count:
            assert rows["coherence"].isna().all()
            continue
        compared += 1
        c, left, m = pair_of(x, y)
        dof = math.floor(2 * count * 2 * m / (2 * count + 2 * m))
        assert np.allclose(rows["coherence"], np.abs(c)) and np.allclose(np.exp(1j * rows["phase"]), np.exp(1j * np.angle(c)))
        assert (rows["dof"] == dof).all()
        assert np.allclose(rows["limit"], math.sqrt(1 - 0.05 ** (1 / (dof / 2 - 1))) if dof > 2 else 1)
        assert np.allclose(rows["phase_sd"], np.sqrt(2 / dof * (1 / np.abs(c) ** 2 - 1)))
        if len(spent) > 1 and len([t for t in spent if t in viewed]) > 1:
            root = math.sqrt(2 * m - 2)
            half = dist.t_quantile(0.975, dof - 1) * math.sqrt(m - 1) * np.std([root * np.arctanh(np.abs(v)) for v in left], axis=0)
            z = root * np.arctanh(np.abs(c))
            assert np.allclose(rows["lower"], np.maximum(np.tanh((z - half) / root), 0)) and np.allclose(rows["upper"], np.tanh((z + half) / root))
            turn = np.abs(np.mean([v / np.abs(v) for v in left], axis=0))
            assert np.allclose(rows["jack_phase_sd"], np.sqrt((2 * m - 2) * (1 - turn)), atol=1e-5)
    assert compared > 5


def segments_of(sid, signals):
    x = signals[sid]
    t = (np.arange(128) + 0.5) / 1000.0
    hz = sq.SEGMENT.hz
    tapers = slepian(128, 3.0, 5) * math.sqrt(1000.0)
    return [np.exp(-2j * np.pi * hz[:, None] * t[None, : len(p)]) @ (tapers[:, : len(p)] * p).T for p in (x[k : k + 128] for k in range(0, len(x), 128))]


@pytest.fixture(scope="module")
def signals(spark):
    from intervalia.sources.fixtures import signals

    return {r.sid: np.array(r.x) for r in signals(spark, SF).collect()}


def test_spectral_errors(spark, signals):
    got = sq.q14_spectral(spark, SF).toPandas()
    assert sorted(got["series"].unique()) == sorted(signals)
    for sid in list(signals)[:8]:
        rows = got[got["series"] == sid].sort_values("hz")
        s, sd, m = jackknife(stacked(segments_of(sid, signals)))
        assert np.allclose(rows["power"], s) and (rows["dof"] == 2 * m).all()
        assert np.allclose(rows["jack_upper"], s * np.exp(dist.t_quantile(0.975, m - 1) * sd))
        assert np.allclose(rows["upper"], 2 * m * s / dist.chi2_quantile(0.025, 2 * m))


def test_two_group_coherence(spark, signals):
    got = sq.q16_coherence(spark, SF).toPandas()
    assert len(got) > 0
    for sid in [s for s in signals if s + 1 in signals and len(signals[s]) == len(signals[s + 1]) == 512][:5]:
        rows = got[got["series"] == sid].sort_values("hz")
        a, b = segments_of(sid, signals), segments_of(sid + 1, signals)
        groups = [pair_of(stacked(a[k : k + 2]), stacked(b[k : k + 2])) for k in (0, 2)]
        z = [np.arctanh(np.abs(c)) - 1 / (2 * m - 2) for c, _, m in groups]
        m1, m2 = groups[0][2], groups[1][2]
        dz = (z[0] - z[1]) / math.sqrt(1 / (2 * m1 - 2) + 1 / (2 * m2 - 2))
        left = [[np.arctanh(np.abs(v)) - 1 / (2 * m - 4) for v in out] for _, out, m in groups]
        one = np.array([m1 * dz - (m1 - 1) * (v - z[1]) / math.sqrt(1 / (2 * m1 - 4) + 1 / (2 * m2 - 2)) for v in left[0]])
        two = np.array([m2 * dz - (m2 - 1) * (z[0] - v) / math.sqrt(1 / (2 * m1 - 2) + 1 / (2 * m2 - 4)) for v in left[1]])
        variance = ((one - one.mean(0)) ** 2).sum(0) / (m1 * (m1 - 1)) + ((two - two.mean(0)) ** 2).sum(0) / (m2 * (m2 - 1))
        assert np.allclose(rows["dz"], dz) and np.allclose(rows["variance"], variance)
        assert (rows["alike"].to_numpy() == (np.abs(dz) <= 1.959963984540054)).all()


def test_segment_coherence(spark, signals):
    got = sq.m08(spark, SF).toPandas()
    sid = next(s for s in signals if s + 1 in signals and len(signals[s + 1]) == 512)
    rows = got[got["series"] == sid].sort_values("hz")
    c, _, m = pair_of(stacked(segments_of(sid, signals)), stacked(segments_of(sid + 1, signals)))
    assert np.allclose(rows["coherence"], np.abs(c)) and np.allclose(rows["limit"], math.sqrt(1 - 0.05 ** (1 / (m - 1))))


def rows_of(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=["series", "trial", "t", "w"]))


def test_limits_hold_what_they_should(spark):
    """The jackknife and chi-squared limits of noise hold its true spectrum about as often as they say."""
    draw = np.random.default_rng(1)
    grid = spectra.Grid(64, 64.0, highest=16.0)
    x = [(s, r, (k + 0.5) / 64, v) for s in range(40) for r in range(2) for k, v in enumerate(draw.normal(size=64))]
    got = spectra.spectra(spectra.transforms(rows_of(spark, x), grid), grid).toPandas()
    # white noise of variance 1, sampled 64 times a unit, has a level of 64 by these sums
    inside = got[(got["hz"] >= 4) & (got["hz"] <= 12)]
    for low, high in (("lower", "upper"), ("jack_lower", "jack_upper")):
        share = ((inside[low] <= 64) & (inside[high] >= 64)).mean()
        assert 0.88 <= share <= 0.99


def test_planted_coherence(spark):
    """Events that follow a wave are coherent with it there, and within chance elsewhere."""
    draw = np.random.default_rng(2)
    grid = spectra.Grid(128, 128.0, highest=30.0)
    wave, events_ = [], []
    for r in range(12):
        turn = draw.uniform(0, 2 * np.pi)
        t = (np.arange(128) + 0.5) / 128
        wave += [(0, r, a, np.sin(2 * np.pi * 10 * a + turn) + 0.5 * draw.normal()) for a in t]
        events_ += [(0, r, a + draw.uniform(-0.003, 0.003), 1.0) for a in t if draw.random() < 0.3 * (1 + np.sin(2 * np.pi * 10 * a + turn))]
    pairs = spectra.paired(spectra.transforms(rows_of(spark, wave), grid), spectra.transforms(rows_of(spark, events_), grid, less_rate=True))
    got = spectra.coherence(pairs, events=True).toPandas()
    at = got[(got["hz"] >= 9.5) & (got["hz"] <= 10.5)]
    off = got[(got["hz"] >= 18) & (got["hz"] <= 28)]
    assert (at["coherence"] > at["limit"]).all() and (at["lower"] > 0.3).all()
    assert (off["coherence"] > off["limit"]).mean() < 0.3


def test_few_rows(spark):
    grid = spectra.Grid(16, 16.0)
    none = rows_of(spark, [(1, 0, 0.2, 1.0), (2, 0, None, 1.0), (3, 0, 0.5, 1.0), (3, 0, 0.5, 1.0)])
    t = spectra.transforms(none, grid, less_rate=True)
    assert sorted({r.series for r in t.collect()}) == [1, 3]
    assert spectra.spectra(t, grid, events=True).count() == 2 * len(grid.hz)
    assert spectra.transforms(none.where("false"), grid).count() == 0


def test_distributions():
    # fixed values: quantiles as printed in common tables
    assert np.allclose(dist.t_quantile(0.975, [1, 2, 10, 30]), [12.7062, 4.30265, 2.22814, 2.04227], rtol=1e-5)
    assert np.allclose(dist.chi2_quantile([0.95, 0.95, 0.025], [1, 10, 20]), [3.84146, 18.30704, 9.59078], rtol=1e-5)
    assert np.allclose(dist.f_quantile([0.95, 0.99], [3, 5], [10, 20]), [3.70826, 4.10268], rtol=1e-5)
    assert np.allclose(dist.normal_quantile([0.975, 0.5, 0.01]), [1.959964, 0.0, -2.326348], atol=1e-5)
    assert np.allclose(dist.f_tail(2.5, 2, 30), 1 - dist.beta_share(1, 15, 2 * 2.5 / (2 * 2.5 + 30)))
    assert np.allclose(dist.chi2_cdf(3.0, 2), 1 - math.exp(-1.5)) and np.allclose(dist.t_two_sided(1.0, 1), 0.5)


def test_binned_spectrum(spark):
    e = events()
    got = sq.m13(spark, SF).toPandas()
    u = int(got["series"].iloc[0])
    own = e[(e["user_id"] == u) & (e["event_type"] == "view")]
    parts, count = [], 0
    for _, x in own.groupby("trial"):
        c = np.bincount((x["t"] * RATE).astype(int), minlength=N)
        wave = np.exp(-2j * np.pi * HZ[:, None] * MIDDLES)
        parts.append(wave @ (TAPERS * (c - c.mean())).T)
        count += len(x)
    s, _, m = jackknife(stacked(parts))
    rows = got[got["series"] == u].sort_values("hz")
    assert np.allclose(rows["power"], s) and np.allclose(rows["rate"], count / (6 * len(parts)))


def test_triggered_spectrum(spark):
    e = events()
    e["us"] = e["ts"].astype("datetime64[us]").astype("int64")
    got = sq.m14(spark, SF).toPandas()
    u = int(got["series"].iloc[0])
    own = e[e["user_id"] == u]
    seen = own[own["event_type"] == "view"]["us"].to_numpy()
    hz = sq.ABOUT.hz
    tapers, middles = slepian(48, 3.0, 5) * math.sqrt(RATE), (np.arange(48) + 0.5) / RATE
    level = np.exp(-2j * np.pi * hz[:, None] * middles) @ tapers.T
    parts, day = [], 86_400_000_000
    for t0 in own[own["event_type"] == "purchase"]["us"]:
        t = (seen[(seen >= t0 - day) & (seen < t0 + day)] - t0 + day) / day
        if len(t):
            w = np.array([[np.interp(a, middles, row) for row in tapers] for a in t])
            parts.append(np.exp(-2j * np.pi * hz[:, None] * t) @ w - level * len(t) / 48)
    rows = got[got["series"] == u].sort_values("hz")
    assert np.allclose(rows["power"], (np.abs(stacked(parts)) ** 2).mean(1))


def test_coherogram(spark):
    e = events()
    got = sq.m15(spark, SF).toPandas()
    u = int(got["series"].iloc[0])
    spent, viewed = spending_of(e, u), views_of(e, u)
    own = got[got["series"] == u]
    assert sorted(set(own["trial"])) == sorted(set(spent) & set(viewed))
    for trial, rows in own.groupby("trial"):
        c, _, _ = pair_of(spent[trial], viewed[trial][0])
        rows = rows.sort_values("hz")
        assert np.allclose(rows["coherence"], np.abs(c)) and np.allclose(np.exp(1j * rows["phase"]), np.exp(1j * np.angle(c)))


def test_welch(spark, signals):
    got = sq.m16(spark, SF).toPandas()
    for sid in list(signals)[:5]:
        x, parts = signals[sid], []
        taper = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / 128) for k in range(128)])
        for s in range(0, len(x) - 127, 64):
            y = (x[s : s + 128] - x[s : s + 128].mean()) * taper
            j = np.array([abs(sum(y * np.exp(-2j * np.pi * f * np.arange(128) / 128))) ** 2 for f in range(65)])
            j[1:64] *= 2
            parts.append(j / 1000 / (taper**2).sum())
        rows = got[got["sid"] == sid].sort_values("hz")
        assert np.allclose(rows["power"], np.mean(parts, 0)) and (rows["windows"] == len(parts)).all()


def test_registered():
    assert {"m05_point_spectrum", "m06_spike_field_coherence", "m07_point_spectrogram", "m08_segment_coherence", "q14_spectral_errors", "q16_two_group_coherence"} <= set(registry.queries())


def test_spike_field_in_one_shuffle(spark, monkeypatch):
    """The same as by rows of transforms, for trials sent as they are and as transforms, and no window or join of transforms."""
    from intervalia.plans import spectral_queries as sq
    from intervalia.sources.fixtures import points

    d = "/root/testdata/sf0.001"
    field, spikes = sq.spending(spark, d), spectra.in_trials(points(spark, d), sq.TRIAL_US, sq.DAY_US)
    key = ["series", "hz"]
    want = spectra.coherence(spectra.paired(spectra.transforms(field, sq.HOURS), spectra.transforms(spikes, sq.HOURS, less_rate=True)), events=True).toPandas().sort_values(key).reset_index(drop=True)
    for few in (128, 2):
        monkeypatch.setattr(spectra, "FEW", few)
        got = spectra.spike_field(field, spikes, sq.HOURS).toPandas().sort_values(key).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, rtol=1e-6, atol=1e-6, check_dtype=False)
    plan = registry.queries()["m06_spike_field_coherence"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
