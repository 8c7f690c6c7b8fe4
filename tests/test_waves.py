"""Signal processing, warping, linkage, boosting, fits and permutations against direct forms."""

import itertools
import math

import numpy as np
import pytest

from intervalia.operators import boosting, dsp, linkage, offsets, resampling, tiles, warp
from intervalia.plans import registry
from intervalia.sources import wav
from intervalia.sources.fixtures import vectors

SF = "/root/testdata/sf0.001"
DRAW = np.random.default_rng(5)


def test_butterworth_has_its_gain():
    for order, kind in ((2, "high"), (4, "low"), (1, "low"), (3, "high")):
        b, a = dsp.butterworth(order, 0.3, kind)
        gain = lambda w: abs(np.polyval(b, np.exp(1j * w)) / np.polyval(a, np.exp(1j * w)))  # noqa: B023, E731
        assert gain(0.3 * np.pi) == pytest.approx(math.sqrt(0.5))
        for w in (0.1, 0.7, 2.0):
            ratio = math.tan(w / 2) / math.tan(0.15 * np.pi)
            assert gain(w) == pytest.approx(1 / math.sqrt(1 + (ratio if kind == "low" else 1 / ratio) ** (2 * order)))
    with pytest.raises(ValueError):
        dsp.butterworth(2, 1.0, "low")


def test_zero_phase_keeps_and_stops():
    t = np.arange(400) / 1000
    slow, fast = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 300 * t)
    assert np.abs(dsp.low_pass(slow + fast, 1000, 50)[50:-50] - slow[50:-50]).max() < 0.02
    assert np.abs(dsp.high_pass(slow + fast, 1000, 50)[50:-50] - fast[50:-50]).max() < 0.05
    assert dsp.low_pass(slow, 1000, 600) is slow
    assert np.allclose(dsp.low_pass(np.full(100, 3.0), 1000, 50), 3.0)


def test_slepian_sequences_concentrate():
    v = dsp.slepian(32, 3.0, 5)
    assert np.allclose(v @ v.T, np.eye(5), atol=1e-9)
    i = np.arange(32)
    with np.errstate(invalid="ignore", divide="ignore"):
        kernel = np.where(i[:, None] == i, 2 * 3.0 / 32, np.sin(2 * np.pi * 3.0 / 32 * (i[:, None] - i)) / (np.pi * (i[:, None] - i)))
    shares = [r @ kernel @ r for r in v]
    assert shares == sorted(shares, reverse=True) and shares[0] > 0.9999 and shares[4] > 0.7


def test_multitaper_by_definition():
    x = DRAW.normal(size=100)
    p, t, f = dsp.multitaper(x, 1000.0, 0.032, 0.016)
    taper, n = dsp.slepian(32, 3.0, 5), np.arange(32)
    want = np.mean([abs(sum(x[16 + n] * w * np.sqrt(1000) * np.exp(-2j * np.pi * 7 * n / 32)) / 1000) ** 2 for w in taper])
    assert p[1, 7] == pytest.approx(want) and f[7] == pytest.approx(7 * 1000 / 32) and t[1] == pytest.approx(33 / 1000) and len(t) == 5
    d, _, _ = dsp.derivative(x, 1000.0, 0.032, 0.016)
    j = [sum(x[16 + n] * w * np.sqrt(1000) * np.exp(-2j * np.pi * 7 * n / 32)) / 1000 for w in taper]
    s = np.mean([j[k] * math.sqrt(k + 1) * np.conj(j[k + 1]) for k in range(4)])
    assert d[0, 1, 7] == pytest.approx(s.real) and d[1, 1, 7] == pytest.approx((1j * s).real)


def test_lines_coherence_and_two_groups():
    t = np.arange(512) / 1000
    tone = np.sin(2 * np.pi * 125 * t)
    v, amplitude, f = dsp.line_test(tone + 0.1 * DRAW.normal(size=512), 1000.0)
    assert f[v.argmax()] == 125 and v.max() > 1000 and amplitude[v.argmax()] == pytest.approx(0.5, rel=0.05)
    x, noise = DRAW.normal(size=512), DRAW.normal(size=512)
    c, phase, _ = dsp.coherence(x, 2 * x, 1000.0)
    assert np.allclose(c, 1) and np.allclose(phase, 0, atol=1e-6) and dsp.coherence(x, noise, 1000.0)[0].mean() < 0.7
    draws = lambda m: (DRAW.normal(size=(m, 4000)) + 1j * DRAW.normal(size=(m, 4000)))
    z = dsp.two_spectra(draws(6), draws(9))
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.06
    assert dsp.digamma(1.0) == pytest.approx(-0.5772156649) and dsp.trigamma(1.0) == pytest.approx(math.pi**2 / 6)


def test_local_line():
    t = np.arange(300.0)
    assert np.allclose(dsp.local_line(3 * t - 5, 50, 25), 3 * t - 5) and np.allclose(dsp.local_line(2 * t[:20], 50, 25), 2 * t[:20])
    x = DRAW.normal(size=300).cumsum()
    y = dsp.local_line(x, 300, 10)
    assert np.allclose(y, np.polyval(np.polyfit(t, x, 1), t)) and len(dsp.local_line(x, 70, 33)) == 300


def test_short_time_round_trip_and_gate():
    x = DRAW.normal(size=400)
    assert np.allclose(dsp.overlap_added(dsp.short_time(x, 64, 16, 128), 64, 16, 128), x[: 16 * 21 + 64], atol=1e-9)
    assert np.allclose(dsp.noise_gate(x, 1000.0, np.zeros(33), 64, 16), x[: 16 * 21 + 64], atol=1e-9)
    quiet = dsp.noise_gate(x, 1000.0, np.full(33, np.inf), 64, 16, smooth_bins=0)
    assert np.allclose(quiet, 0.1 * x[: 16 * 21 + 64], atol=1e-9)


def test_yin_finds_a_tone():
    t = np.arange(2000) / 1000
    for hz in (31.0, 50.0, 97.0):
        apart, pitch = dsp.yin(np.sin(2 * np.pi * hz * t), 1000.0, 20.0, 200.0, 128, 64)
        assert np.abs(pitch - hz).max() < 0.5 and apart.max() < 0.1
    assert np.isnan(dsp.yin(np.zeros(500), 1000.0, 20.0, 200.0, 128, 64)[1]).all()


def test_cepstra_by_definition():
    power, f = DRAW.random((3, 129)) + 0.1, np.arange(129) * 4000 / 128
    bank = dsp.mel_filters(f)
    c = dsp.cepstra(power, f)
    loud = np.log10(np.maximum(bank @ power[1], 1e-12))
    want = [sum(loud[m] * math.cos(math.pi / 40 * k * (m + 0.5)) for m in range(40)) * math.sqrt(2 / 40) / (math.sqrt(2) if k == 0 else 1) for k in range(13)]
    assert c.shape == (13, 3) and np.allclose(c[:, 1], want)
    fine = np.linspace(0, 8000, 400_001)
    area = dsp.mel_filters(fine).sum(1) * (fine[1] - fine[0])
    assert len(bank) == 40 and np.allclose(area, 1, atol=1e-3)


def test_syllables_of_two_bumps():
    t = np.arange(200) / 1000
    p = 0.01 + np.exp(-(((t - 0.05) / 0.01) ** 2)) + 2 * np.exp(-(((t - 0.14) / 0.01) ** 2)) + 1e-4 * np.cos(400 * t)
    found = dsp.syllables(p, t, flat=2.5, amp=1.5, border=1.0)
    assert len(found) == 2 and found[0][0] < 0.05 < found[0][1] < found[1][0] < 0.14 < found[1][1]
    assert len(dsp.syllables(p, t, flat=2.5, amp=1.5, border=1.0, power=1.5)) == 1 and dsp.syllables(p[:2], t[:2]) == []
    loud = np.array([0, 0, 0, 1, 0, 1, 1, 0, 0, 0], bool)
    assert dsp.widened(loud, 5, 6, 1, 2) == (3, 7) and dsp.widened(np.ones(4, bool), 2, 3, 1, 2) == (0, 4)


def test_wav_round_trip(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0])
    rate, y = wav.decoded(wav.encoded(x, 8000))
    assert rate == 8000 and np.array_equal(y[:, 0], x)
    (tmp_path / "a.wav").write_bytes(wav.encoded(np.stack([x, -x], 1), 44100))
    row = wav.read_wav(spark, str(tmp_path), 1).first()
    assert (row.rate, row.length) == (44100, 5) and np.allclose(row.x, np.clip(-x, -1, 32767 / 32768))
    for bad in (b"", b"RIFF0000WAVE", b"x" * 60):
        with pytest.raises(ValueError):
            wav.decoded(bad)


def warped(a, b, margin=5, penalty=1.0):
    """Every cell of the table, by the recursion."""
    n, m = a.shape[1], b.shape[1]
    best = {}
    for i, j in itertools.product(range(n), range(m)):
        if not max(0, i - margin) <= j < i + m - n + margin:
            continue
        ways = [0.0] if (i, j) == (0, 0) else []
        if i == 0 and j:
            ways.append(best.get((0, j - 1), math.inf) + penalty)
        if i and j:
            ways += [best.get((i - 1, j - 1), math.inf), best.get((i - 1, j), math.inf) + penalty, best.get((i, j - 1), math.inf) + penalty]
        best[i, j] = min(ways, default=math.inf) + ((a[:, i] - b[:, j]) ** 2).sum()
    return math.sqrt(best[n - 1, m - 1])


def test_time_warp(spark):
    for n, m in ((8, 8), (5, 9), (12, 16), (16, 11)):
        a, b = DRAW.normal(size=(6, 2, n)), DRAW.normal(size=(6, 2, m))
        want = [warped(x, y) if n <= m else warped(y, x) for x, y in zip(a, b)]
        assert np.allclose(warp.warp_block(a, b), want)
    assert np.allclose(warp.warp_block(a, a), 0)
    v = {r.vec_id: 10 * np.array(r.v).reshape(4, 16) for r in vectors(spark, SF).where("vec_id < 12").collect()}
    got = {(r.i, r.j): r.d for r in registry.queries()["p04_time_warp"](spark, SF).where("j < 12").collect()}
    assert got.keys() == {(i, j) for i in v for j in v if i < j} and all(abs(d - warped(v[i], v[j])) < 1e-6 for (i, j), d in got.items())
    long = {r: (r.i, r.j) for r in registry.queries()["p05_length_normalised_warp"](spark, SF).where("j < 12").collect()}
    for r, (i, j) in long.items():
        x, y = v[i][:, : 16 - i % 6], v[j][:, : 16 - j % 6]
        x, y = (x, y) if x.shape[1] <= y.shape[1] else (y, x)
        assert abs(r.d - warped(x, y) / ((x.shape[1] + y.shape[1]) / 2000)) < 1e-6


def test_tiles_and_offsets(spark):
    rows = [(i, [float(x) for x in DRAW.normal(size=64)], i % 3) for i in range(23)] + [(None, [0.0] * 64, 1)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    x = {i: np.array(w) for i, w, _ in rows if i is not None}
    got = {(r.i, r.j): r.d for r in tiles.pairs(v, tiles.euclidean, size=4).collect()}
    assert got.keys() == {(i, j) for i in x for j in x if i < j} and all(abs(d - np.linalg.norm(x[i] - x[j])) < 1e-9 for (i, j), d in got.items())
    for r in offsets.slid(v).collect():
        t, w = x[r.i][:32], [x[r.j][o : o + 32] for o in range(33)]
        c = np.array([t @ u / np.sqrt((t @ t) * (u @ u)) for u in w])
        assert np.allclose([r.distance, r.mean, r.most, r.least, r.median, r.rms], [min(np.linalg.norm(t - u) for u in w), c.mean(), c.max(), c.min(), np.median(c), np.sqrt((c * c).mean())])
    assert tiles.pairs(v.where("false"), tiles.euclidean).count() == 0


def linked(d, rule):
    """Heights of merges by the definition of each rule over the members."""
    groups, heights = [[i] for i in range(len(d))], []
    weight = {(i, j): d[i, j] for i in range(len(d)) for j in range(len(d))}
    names = list(range(len(d)))
    far = dict(weight)
    while len(groups) > 1:
        def gap(p, q):
            x, y = groups[p], groups[q]
            if rule == "single":
                return min(d[i, j] for i in x for j in y)
            if rule == "complete":
                return max(d[i, j] for i in x for j in y)
            if rule == "average":
                return sum(d[i, j] for i in x for j in y) / len(x) / len(y)
            return far[names[p], names[q]]

        h, p, q = min((gap(p, q), p, q) for p in range(len(groups)) for q in range(p + 1, len(groups)))
        heights.append(h)
        new = len(d) + len(heights) - 1
        for r in range(len(groups)):
            if r not in (p, q):
                far[new, names[r]] = far[names[r], new] = (far[names[p], names[r]] + far[names[q], names[r]]) / 2
        groups[p], names[p] = groups[p] + groups[q], new
        del groups[q], names[q]
    return heights


def test_linkage():
    for rule in ("single", "complete", "average", "weighted"):
        for n in (1, 2, 3, 9, 14):
            x = DRAW.normal(size=(n, 3))
            d = tiles.euclidean(x, x)
            assert np.allclose(linkage.merges(d, rule)[:, 2], linked(d, rule))
    x = DRAW.normal(size=(12, 2))
    tree = linkage.merges(tiles.euclidean(x, x), "ward")
    last = linkage.cut(tree, 12, 2)
    a, b = x[last == 1], x[last == 2]
    assert tree[-1, 2] == pytest.approx(math.sqrt(2 * len(a) * len(b) / 12) * np.linalg.norm(a.mean(0) - b.mean(0)))
    cuts = [linkage.cut(tree, 12, k) for k in range(1, 13)]
    for k, c in enumerate(cuts, 1):
        assert len(set(c)) == k
    for coarse, fine in zip(cuts, cuts[1:]):
        assert len(set(zip(coarse, fine))) == len(set(fine))
    with pytest.raises(ValueError):
        linkage.merges(np.zeros((2, 2)), "other")
    assert [linkage.letters(k) for k in (1, 26, 27)] == ["a", "z", "A"]


def test_linkage_of_groups(spark):
    v = spark.createDataFrame([(k, [float(k), 0.0], 0) for k in range(6)], "vec_id long, v array<double>, label int")
    got = sorted(linkage.cuts(v, [2], "label").collect())
    tree = linkage.merges(tiles.euclidean(*[np.array([[float(k), 0.0] for k in range(6)])] * 2))
    assert [r.cluster for r in got] == linkage.cut(tree, 6, 2).tolist() and len({r.cluster for r in got}) == 2
    assert linkage.narrowed(v, "label").count() == 3 and linkage.cuts(v.where("false"), [2]).count() == 0


def test_boosting():
    x = DRAW.normal(size=(600, 4))
    y = np.where((x[:, 0] > 0) ^ (x[:, 1] > 0.3), 1, -1)
    for kind in ("gentle", "real", "modest"):
        trees = boosting.fit(x[:400], y[:400], kind, rounds=40)
        assert (np.sign(boosting.scores(trees, x[400:])) == y[400:]).mean() > 0.9, kind
    assert boosting.fit(x[:0], y[:0]) == [] and (boosting.scores(boosting.fit(x, np.ones(600), rounds=2), x) > 0).all()
    with pytest.raises(ValueError):
        boosting.fit(x, y, "other")


def test_boosting_of_the_tables(spark):
    got = {(r.y, r.predicted): r.n for r in registry.queries()["k01_gentle_boosting"](spark, SF).collect()}
    assert sum(got.values()) == 500 and got[1, 1] + got[-1, -1] > 450
    folds = registry.queries()["k02_boosting_folds"](spark, SF).collect()
    assert all(sum(r.n for r in folds if r.kind == k) == 500 for k in ("real", "modest"))


def test_sign_flips(spark):
    rows = [(k % 2, k, float(x)) for k, x in enumerate(DRAW.normal(size=60) + 0.5)]
    got = {r.key: r for r in resampling.sign_flips(spark.createDataFrame(rows, "key long, id long, d double"), 200).collect()}
    for key in (0, 1):
        ids = np.array([i for k, i, _ in rows if k == key])
        d = np.array([x for k, _, x in rows if k == key])
        flipped = resampling.signs(ids, 200) * d[:, None]
        t = flipped.mean(0) / (flipped.std(0, ddof=1) / math.sqrt(len(d)))
        assert got[key].n == len(d) and got[key].t == pytest.approx(t[0]) and got[key].p == pytest.approx((abs(t) >= abs(t[0]) - 1e-9).mean())
    assert abs(resampling.signs(np.arange(4000), 50)[:, 1:].mean()) < 0.02


def test_durations(spark):
    x = DRAW.exponential(0.2, 20000)
    inside = x[(x > 0.1) & (x < 0.8)]
    row = resampling.durations(spark.createDataFrame([(1, float(v)) for v in x], "key long, x double"), 0.1, 0.8).first()
    assert row.n == len(inside) and row.tau == pytest.approx(0.2, rel=0.05)
    s, m = np.sort(inside), inside.mean()
    k = np.arange(1, len(s) + 1) / len(s)
    cdf = 1 - np.exp(-s / m)
    assert row.ks == pytest.approx(max(np.abs(k - cdf).max(), np.abs(k - 1 / len(s) - cdf).max()) * math.sqrt(len(s)))
    assert resampling.decay(0.5, 0.1, 0.8) == math.inf


def test_bump():
    x = np.arange(60) * 0.1
    h, at, width, r2 = resampling.bump(x, 3 * np.exp(-(((x - 2.2) / 0.7) ** 2)))
    assert (h, at, width, r2) == pytest.approx((3, 2.2, 0.7, 1), rel=1e-4)
    assert resampling.bump(x, np.zeros(60)) == (0.0, 0.0, 0.0, 0.0)


def test_regressions(spark):
    v = np.array([r.v for r in vectors(spark, SF).orderBy("vec_id").collect()])
    for r in registry.queries()["a09_regressions"](spark, SF).where("response = 3").collect():
        x = np.column_stack([np.ones(len(v)), v[:, 8:16]])
        beta, left, *_ = np.linalg.lstsq(x, v[:, 3], rcond=None)
        se = np.sqrt(left[0] / (len(v) - 9) * np.diag(np.linalg.inv(x.T @ x)))
        k = r.predictor - 7
        assert (r.beta, r.se, r.t) == pytest.approx((beta[k], se[k], beta[k] / se[k]))


def test_pruned_features(spark):
    from intervalia.plans.learning_queries import pruned

    x = DRAW.normal(size=(40, 3))
    rows = [(k, [float(a) for a in r], k % 2) for k, r in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    t = np.stack([z[k::2].mean(0) for k in (0, 1)])
    gap = np.abs(z[:, None] - t[None])
    d = np.sqrt((gap**2).sum(2))
    want = (gap / d[..., None]).mean((0, 1))
    assert np.allclose([r.contribution for r in pruned(v, 100.0, 0.4).orderBy("dim").collect()], want)
    left = [r.dim for r in pruned(v, 0.0, 0.4).orderBy("dim").collect()]
    assert len(left) < 3 and pruned(v.where("false"), 1.0, 0.4).count() == 0
