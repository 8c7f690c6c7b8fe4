"""Rows of the registered queries of signals, distances and learning against plain computations from the tables."""

import math

import numpy as np
import pandas as pd
import pytest

from intervalia.operators import boosting, dsp
from intervalia.operators.dsp import slepian
from intervalia.plans import registry
from intervalia.sources.fixtures import vectors

SF = "/root/testdata/sf0.001"
Q = registry.queries()
T = np.arange(64)


@pytest.fixture(scope="module")
def signals():
    v = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x = np.stack(v["embedding"].to_numpy()).astype(float)
    return {int(s): x[v["vec_id"] // 8 == s].reshape(-1) for s in sorted(set(v["vec_id"] // 8))}


def rows(spark, name, sid=None, key="sid"):
    got = Q[name](spark, SF).toPandas()
    return got if sid is None else got[got[key] == sid]


def whole(x, k=5, bandwidth=3.0):
    """Tapered transforms (tapers, frequencies) of a series, its length being a power of two, and frequencies."""
    n = len(x)
    f = np.arange(n // 2 + 1)
    wave = np.exp(-2j * np.pi * np.outer(f, np.arange(n)) / n)
    return (wave @ (slepian(n, bandwidth, k) * math.sqrt(1000) * x).T / 1000).T, f * 1000 / n


def windows(x, k=5, bandwidth=3.0):
    """The same of windows of 64, 16 apart (windows, tapers, frequencies), and times of their middles."""
    starts = range(0, len(x) - 63, 16)
    wave = np.exp(-2j * np.pi * np.outer(np.arange(33), T) / 64)
    tapers = slepian(64, bandwidth, k) * math.sqrt(1000)
    return np.array([(wave @ (tapers * x[s : s + 64]).T / 1000).T for s in starts]), np.array([(s + 33) / 1000 for s in starts])


HZ = np.arange(33) * 1000 / 64


def test_whole_spectra_and_lines(spark, signals):
    power, lines = rows(spark, "m01_series_spectrum"), rows(spark, "m02_line_test")
    used = {s for s, x in signals.items() if len(x) >= 128}
    assert set(power["sid"]) == set(lines["sid"]) == used
    for sid in [s for s in used if len(signals[s]) == 512][:6]:
        j, f = whole(signals[sid])
        own = power[power["sid"] == sid].sort_values("hz")
        assert np.allclose(own["hz"], f) and np.allclose(own["power"], (np.abs(j) ** 2).mean(0))
        sums = slepian(512, 3.0, 5).sum(1) * math.sqrt(1000) / 1000
        sums[1::2] = 0
        a = (sums @ j) / (sums**2).sum()
        rest = (np.abs(j - np.outer(sums, a)) ** 2).sum(0)
        own = lines[lines["sid"] == sid].sort_values("hz")
        assert np.allclose(own["F"], 4 * np.abs(a) ** 2 * (sums**2).sum() / rest) and np.allclose(own["amplitude"], np.abs(a))


def test_coherence_of_neighbours(spark, signals):
    got, z = rows(spark, "m03_coherence"), rows(spark, "q16_two_group_spectrum")
    pairs = [s for s in signals if s + 1 in signals and len(signals[s]) == len(signals[s + 1])]
    assert sorted(set(got["sid"])) == sorted(set(z["sid"])) == pairs
    for sid in pairs[:6]:
        (a, f), (b, _) = whole(signals[sid]), whole(signals[sid + 1])
        c = (a.conj() * b).mean(0) / np.sqrt((np.abs(a) ** 2).mean(0) * (np.abs(b) ** 2).mean(0))
        own = got[got["sid"] == sid].sort_values("hz")
        assert np.allclose(own["coherence"], np.abs(c)) and np.allclose(np.exp(1j * own["phase"]), np.exp(1j * np.angle(c)))
        gap = np.log((np.abs(a) ** 2).mean(0)) - np.log((np.abs(b) ** 2).mean(0))
        # the variance of the log of a mean of five squares, twice
        spread = math.sqrt(2 * (math.pi**2 / 6 - sum(1 / k**2 for k in range(1, 5))))
        assert np.allclose(z[z["sid"] == sid].sort_values("hz")["z"], gap / spread)


def test_segment_spectra(spark, signals):
    got = rows(spark, "m04_segment_spectra")
    for sid in [s for s in signals if len(signals[s]) >= 128][:6]:
        x = signals[sid]
        parts = [whole(x[k : k + 128])[0] for k in range(0, len(x) - 127, 128)]
        own = got[got["sid"] == sid].sort_values("hz")
        assert np.allclose(own["power"], np.mean([(np.abs(j) ** 2).mean(0) for j in parts], 0)) and (own["segments"] == len(parts)).all()


def curves(x):
    """The curves of a signal from the definitions, but for periodicity."""
    j, t = windows(x)
    p = (np.abs(j) ** 2).mean(1)
    s = sum(j[:, k] * math.sqrt(k + 1) * j[:, k + 1].conj() for k in range(4)) / 4
    time, freq = s.real, (1j * s).real
    total = p.sum(1)
    c = np.abs(np.array([[sum(row * np.exp(-2j * np.pi * m * np.arange(33) / 33)) for m in range(17)] for row in time]))
    return t, {
        "power": total, "entropy": np.log(p + 1e-12).mean(1) - np.log(p.mean(1) + 1e-12), "centre": (p * HZ).sum(1) / total, "fm": np.degrees(np.arctan2((time**2).max(1), (freq**2).max(1))),
        "am": -time.sum(1) / total / 16, "goodness": c.max(1), "harmonic": 1000 / (c.argmax(1) + 1),
    }


def test_spectrum_statistics(spark, signals):
    got, pitch = rows(spark, "d11_spectrum_statistics"), rows(spark, "d16_harmonic_pitch")
    for sid in list(signals)[:5]:
        t, want = curves(signals[sid])
        own = got[got["sid"] == sid].sort_values("t")
        assert np.allclose(own["t"], t)
        for name, c in want.items():
            assert np.allclose(own[name], c, rtol=1e-5, atol=1e-9), name
        own = pitch[pitch["sid"] == sid].sort_values("t")
        assert np.allclose(own["goodness"], want["goodness"]) and np.allclose(own["harmonic"], want["harmonic"])


def plain_yin(x):
    """Aperiodicity and pitch of windows of 64, 16 apart, for 20 to 400 Hz, lag by lag."""
    longest, shortest = 50, 2
    out = []
    for s in range(0, len(x) - (64 + longest + 1) + 1, 16):
        w = x[s : s + 64 + longest + 1]
        d = [sum((w[n] - w[n + lag]) ** 2 for n in range(64)) for lag in range(longest + 2)]
        norm = [1.0] + [d[k] * k / sum(d[1 : k + 1]) if sum(d[1 : k + 1]) > 0 else 1.0 for k in range(1, longest + 2)]
        dips = [k for k in range(shortest, longest + 1) if norm[k] < 0.1 and norm[k] <= norm[k + 1]]
        k = dips[0] if dips else min(range(shortest, longest + 1), key=lambda m: (norm[m], m))
        bend = norm[k - 1] - 2 * norm[k] + norm[k + 1]
        shift = max(-1.0, min(1.0, (norm[k - 1] - norm[k + 1]) / (2 * bend))) if bend > 0 else 0.0
        out.append((norm[k], 1000 / (k + shift)) if norm[k] < 1 else (1.0, 100.0))
    return np.array(out)


def test_periodicity(spark, signals):
    got = rows(spark, "d17_periodicity")
    for sid in list(signals)[:3]:
        own = got[got["sid"] == sid].sort_values("t")
        want = plain_yin(signals[sid])
        assert np.allclose(own["aperiodicity"], want[:, 0]) and np.allclose(own["pitch"], want[:, 1])
        assert np.allclose(own["t"], (32 + 16 * np.arange(len(want))) / 1000)


def plain_cepstra(x):
    j, _ = windows(x)
    p = (np.abs(j) ** 2).mean(1)
    edge = [20.0 + 12 * k for k in range(13)]
    edge += [edge[-1] * 1.07**k for k in range(1, 17)]
    loud = []
    for a, b, c in zip(edge, edge[1:], edge[2:]):
        weight = np.array([max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a) for f in HZ])
        loud.append(np.log10(np.maximum(p @ weight, 1e-12)))
    m = len(loud)
    return np.array([sum(row * math.cos(math.pi / m * k * (i + 0.5)) for i, row in enumerate(loud)) * math.sqrt((1 if k == 0 else 2) / m) for k in range(13)])


def test_cepstra(spark, signals):
    got = rows(spark, "d18_cepstra")
    for sid in list(signals)[:5]:
        own = got[got["sid"] == sid].sort_values(["c", "t"])
        want = plain_cepstra(signals[sid])
        assert len(own) == want.size and np.allclose(own["value"], want.reshape(-1), atol=1e-6)


def test_two_taper_features(spark, signals):
    got = rows(spark, "d19_two_taper_features")
    for sid in list(signals)[:5]:
        j, t = windows(signals[sid], 2, 1.5)
        p = (np.abs(j) ** 2).mean(1)
        loud = np.log(p + 1e-12)
        own = got[got["sid"] == sid].sort_values("t")
        c = np.abs(np.array([[sum((row - row.mean()) * np.exp(-2j * np.pi * m * np.arange(33) / 33)) for m in range(1, 17)] for row in loud]))
        assert np.allclose(own["amplitude"], 10 * np.log10(p.sum(1) + 1e-12)) and np.allclose(own["centre"], (p * HZ).sum(1) / p.sum(1))
        assert np.allclose(own["entropy"], loud.mean(1) - np.log(p.mean(1) + 1e-12)) and np.allclose(own["pitch"], 1000 / (1 + c.argmax(1))) and np.allclose(own["t"], t)


def test_clips(spark, signals):
    """The clip of each signal is samples 32 to 351 of it, gated by its own quiet parts and filtered."""
    got = rows(spark, "d04_clip_and_process")
    assert set(got["sid"]) == {s for s, x in signals.items() if len(x) >= 128}
    for sid in list(signals)[:5]:
        x = signals[sid]
        clip = x[32 : min(len(x), 352)]
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * T / 64)
        spectra = np.array([[abs(sum(x[s + T] * hann * np.exp(-2j * np.pi * f * T / 64))) ** 2 for f in range(33)] for s in range(0, len(x) - 63, 16)])
        same = np.abs(dsp.short_time(x, 64, 16, 64)) ** 2
        # the window of the transform may be scaled; its shape is what counts
        assert np.allclose(same / same.sum(), spectra / spectra.sum(), rtol=0.2, atol=1e-3)
        y = dsp.low_pass(dsp.high_pass(dsp.noise_gate(clip, 1000.0, np.quantile(same, 0.3, axis=0), 64, 16), 1000.0, 20.0), 1000.0, 400.0)
        own = got[got["sid"] == sid].sort_values("k")
        assert np.allclose(own["y"], y) and len(own) == (len(clip) - 64) // 16 * 16 + 64


def test_stepped_sounds(spark, signals):
    got = rows(spark, "g01_stepped_sounds")
    for sid in list(signals)[:6]:
        x = signals[sid]
        loud = set()
        spans = []
        for begin in range(0, max(1, len(x) - 255), 192):
            part = dsp.high_pass(x[begin : begin + 256], 1000.0, 20.0)
            j, t = windows(part, 1, 1.0)
            p = (np.abs(j) ** 2).mean(1).sum(1)
            on = [k for k in range(len(p)) if p[k] > np.median(p)]
            for k in on:
                if k - 1 not in on:
                    start = k
                if k + 1 not in on:
                    spans.append((begin / 1000 + t[start], begin / 1000 + t[k]))
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(merged[-1][1], b)
            else:
                merged.append((a, b))
        own = got[got["sid"] == sid].sort_values("start")
        assert np.allclose(own[["start", "stop"]], np.array(merged)) and not loud


def sounds(x):
    j, t = windows(x, 1, 1.0)
    p = (np.abs(j) ** 2).mean(1).sum(1)
    smooth = np.array([sum(p[max(0, k - 1) : k + 2]) / 3 for k in range(len(p))]) + 1e-12
    return dsp.syllables(smooth, t, flat=1.2, rise=0.0, amp=1.1, power=float(np.quantile(smooth, 0.5))), p, t


def test_syllables(spark, signals):
    got, wide, full = rows(spark, "g03_syllables"), rows(spark, "g06_widened_borders"), rows(spark, "g04_syllables_with_features")
    for sid in list(signals)[:6]:
        x = signals[sid]
        found, p, t = sounds(x)
        own = got[got["sid"] == sid].sort_values("start")
        assert np.allclose(own[["start", "stop"]].to_numpy().reshape(-1, 2), np.array(found).reshape(-1, 2))
        loud = p > np.quantile(p, 0.6)
        want = []
        for a, b in found:
            lo, hi = int(np.argmin(np.abs(t - a))), int(np.argmin(np.abs(t - b))) + 1
            while lo > 0 and (lo < 2 or loud[lo - 2 : lo].any()):
                lo -= 1
            while hi < len(t) and (hi + 2 > len(t) or loud[hi : hi + 2].any()):
                hi += 1
            want.append((t[lo], t[hi - 1]))
        own = wide[wide["sid"] == sid].sort_values(["start", "stop"])
        assert np.allclose(own[["start", "stop"]].to_numpy().reshape(-1, 2), np.array(sorted(want)).reshape(-1, 2))
        y = dsp.low_pass(dsp.high_pass(x, 1000.0, 20.0), 1000.0, 400.0)
        joined = []
        for a, b in sounds(y)[0]:
            if joined and a - joined[-1][1] <= 0.01:
                joined[-1] = joined[-1][0], b
            else:
                joined.append((a, b))
        times, c = curves(y)
        own = full[full["sid"] == sid].sort_values("start")
        kept = [(a, b) for a, b in joined if b - a >= 0.02]
        assert len(own) == len(kept)
        for r, (a, b) in zip(own.itertuples(), kept):
            inside = (times >= a) & (times <= b)
            assert np.isclose(r.start, a) and np.isclose(r.stop, b) and np.isclose(r.power, c["power"][inside].mean()) and np.isclose(r.centre, c["centre"][inside].mean()) and np.isclose(r.fm, c["fm"][inside].mean())


def test_signal_features(spark, signals):
    got, short = rows(spark, "a02_signal_features"), rows(spark, "a03_short_filter_features")
    assert set(short["sid"]) == {s for s, x in signals.items() if len(x) >= 256}
    for sid in list(signals)[:4]:
        t, want = curves(signals[sid])
        for name, c in want.items():
            r = got[(got["sid"] == sid) & (got["curve"] == name)].iloc[0]
            place = np.round(t * 1000)
            ordered = sorted(zip(place, c))
            at = lambda share: ordered[math.ceil(len(c) * share) - 1][1]  # noqa: B023, E731
            assert np.allclose([r["mean"], r["std"], r["max"], r["min"], r["attack"], r["sustain"], r["release"]], [c.mean(), c.std(ddof=1), c.max(), c.min(), at(0.1), at(0.5), at(0.9)], rtol=1e-5)
            trend = np.corrcoef(c, place)[0, 1] if c.std() > 0 else 0.0
            assert np.isclose(r["lintrend"], trend, atol=1e-6) and np.isclose(c[list(place).index(r["peak"])], c.max()) and np.isclose(c[list(place).index(r["trough"])], c.min())
        _, want = curves(dsp.high_pass(signals[sid], 1000.0, 20.0))
        r = short[short["sid"] == sid].iloc[0]
        assert np.isclose(r["length"], len(signals[sid]) / 1000) and all(np.isclose(r[n], c.mean(), rtol=1e-5) for n, c in want.items())


def plain_warp(a, b, margin=5, penalty=1.0):
    n, m = a.shape[1], b.shape[1]
    if n > m:
        a, b, n, m = b, a, m, n
    best = np.full((n, m), np.inf)
    for i in range(n):
        for j in range(max(0, i - margin), min(m, i + m - n + margin)):
            cost = ((a[:, i] - b[:, j]) ** 2).sum()
            if i == 0:
                reach = best[0, j - 1] + penalty if j else 0.0
            elif j == 0:
                continue
            else:
                reach = min(best[i - 1, j - 1], min(best[i - 1, j], best[i, j - 1]) + penalty)
            best[i, j] = reach + cost
    return math.sqrt(best[-1, -1])


def test_cepstral_warp(spark, signals):
    got = rows(spark, "p06_cepstral_warp")
    long = [s for s in signals if len(signals[s]) == 512]
    assert len(got) == len(long) * (len(long) - 1) // 2
    own = got.set_index(["i", "j"])["d"]
    for i, j in [(0, 1), (2, 9), (5, 30)]:
        assert np.isclose(own[long[i], long[j]], plain_warp(plain_cepstra(signals[long[i]]), plain_cepstra(signals[long[j]])), atol=1e-6)


def test_distance_panel(spark):
    got = rows(spark, "p18_distance_panel").set_index(["i", "j"])
    v = pd.read_parquet(f"{SF}/embeddings.parquet").set_index("vec_id")["embedding"]
    n = len(v)
    assert len(got) == n * (n - 1) // 2
    for i, j in [(0, 1), (3, 77), (100, 400)]:
        a, b = (np.asarray(v[k], float) for k in (i, j))
        r = got.loc[(i, j)]
        assert np.isclose(r["euclidean"], np.linalg.norm(a - b)) and np.isclose(r["warped"], plain_warp(10 * a.reshape(4, 16), 10 * b.reshape(4, 16)))
        assert r["least"] <= r["median"] <= r["most"] and r["least"] <= r["mean"] <= r["rms"] <= r["most"] + 1e-9


def test_boosted_classes(spark):
    """Scores are the sums of the trees that the fit gives; classes their signs; shares those of the classes."""
    from intervalia.plans.learning_queries import examples

    x = examples(spark, SF)
    model = boosting.fit(*boosting.sample(x), rounds=40)
    got = rows(spark, "k03_classify").set_index("vec_id")
    again = boosting.classified(x, model).toPandas().set_index("vec_id")
    assert np.allclose(got["score"], again.loc[got.index, "score"]) and (got["predicted"] == np.where(got["score"] > 0, 1, -1)).mean() > 0.99
    label = pd.read_parquet(f"{SF}/embeddings.parquet").set_index("vec_id")["label"]
    share = (got["predicted"] == 1).groupby(label.loc[got.index]).mean()
    found = rows(spark, "k12_noise_labels").set_index("label")["share"]
    assert np.allclose(found.sort_index(), share.sort_index())
    hit = ((got["predicted"] == 1) == (label.loc[got.index] == 0)).mean()
    assert hit > 0.9


def test_song_scores(spark):
    v = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(v["embedding"].to_numpy()).astype(float)
    got = rows(spark, "k10_song_scores").set_index(["vec_id", "type"])
    assert len(got) == len(v) * v["label"].nunique()
    for label in sorted(set(v["label"]))[:3]:
        mean = x[v["label"] == label].mean(0)
        for k in (0, 17, 200):
            gaps = [np.linalg.norm(x[k, 16 * s : 16 * s + 16] - mean[16 * s : 16 * s + 16]) for s in range(4)]
            r = got.loc[(v["vec_id"].iloc[k], label)]
            assert np.isclose(r["evidence"], sum(gaps), atol=1e-5) and np.isclose(r["worst"], max(gaps), atol=1e-5)


def test_common_string(spark):
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    grams, of = {}, {}
    for u, own in e.groupby("user_id"):
        c, w = own["event_type"].str[0].tolist(), own["value"].tolist()
        of[u] = [(tuple(c[k : k + 4]), w[k : k + 4]) for k in range(len(c) - 3)]
        for g, _ in of[u]:
            grams[g] = grams.get(g, 0) + 1
    top = min(grams, key=lambda g: (-grams[g], g))
    like = {u: [sum(b for a, t, b in zip(g, top, w) if a == t) / sum(w) for g, w in own] for u, own in of.items() if own}
    best = {u: max(v) for u, v in like.items()}
    middle = np.mean(list(best.values()))
    cut = (np.mean([b for b in best.values() if b > middle]) + np.mean([b for b in best.values() if b <= middle])) / 2
    got = {r.user_id: r for r in Q["n03_common_string"](spark, SF).collect()}
    assert set(got) == set(best)
    for u, r in got.items():
        assert np.isclose(r["best"], best[u], atol=1e-8) and np.isclose(r["mean"], np.mean(like[u]), atol=1e-8) and r["accepted"] == (best[u] > cut)


def test_exemplars_and_recut(spark):
    """A recut of the tree of all vectors: the pairs that the cut joins have the distances that complete linkage allows."""
    v = vectors(spark, SF).toPandas().set_index("vec_id")["v"]
    got = rows(spark, "c25_recut_and_exemplars").set_index("vec_id")
    assert len(got) == len(v) and got["cluster"].nunique() == 12
    for _, own in got.groupby("cluster"):
        assert set(own["exemplar"]) == {own.index.min()} and set(own["n"]) == {len(own)}
    assert got["n"].sum() == (got["cluster"].value_counts() ** 2).sum()


def test_running_lines(spark, signals):
    smooth, rest = rows(spark, "d29_running_line"), rows(spark, "d23_local_detrend")
    for sid in list(signals)[:6]:
        x = signals[sid]
        n = len(x)
        total, weight = np.zeros(n), np.zeros(n)
        for begin in sorted({*range(0, n - 99, 50), n - 100}):
            t = np.arange(100)
            slope = ((t - 49.5) * x[begin : begin + 100]).sum() / ((t - 49.5) ** 2).sum()
            w = (1 - np.abs((t + 1 - 50.5) / 50.5) ** 3) ** 3
            total[begin : begin + 100] += w * (x[begin : begin + 100].mean() + slope * (t - 49.5))
            weight[begin : begin + 100] += w
        assert np.allclose(smooth[smooth["sid"] == sid].sort_values("k")["y"], total / weight)
        assert np.allclose(rest[rest["sid"] == sid].sort_values("k")["y"], x - total / weight)
