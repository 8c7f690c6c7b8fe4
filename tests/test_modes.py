"""Channel modes, changes of power and best regions against direct forms."""

import math

import numpy as np
import pandas as pd
import pytest

from intervalia.operators import quadratic, regions
from intervalia.operators.dsp import slepian
from intervalia.plans import mode_queries as mq
from intervalia.plans import spectral_queries as sq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def signals(spark):
    from intervalia.sources.fixtures import signals

    return {r.sid: np.array(r.x) for r in signals(spark, SF).collect()}


def transform(p):
    t = (np.arange(128) + 0.5) / 1000.0
    tapers = slepian(128, 3.0, 5) * math.sqrt(1000.0)
    return np.exp(-2j * np.pi * sq.SEGMENT.hz[:, None] * t[None, : len(p)]) @ (tapers[:, : len(p)] * p).T


def blocks(signals):
    """Transforms (channels, frequencies, tapers) by block and trial, zero where a channel has no samples."""
    out = {}
    for b in sorted({s // 8 for s in signals}):
        own = [signals[s] for s in sorted(signals) if s // 8 == b]
        for trial in range(-(-max(map(len, own)) // 128)):
            out[b, trial] = np.stack([transform(x[128 * trial : 128 * trial + 128]) for x in own])
    return out


def test_space_modes(spark, signals):
    got = mq.m09(spark, SF).toPandas()
    for (b, trial), j in blocks(signals).items():
        j = j[[len(signals[s]) > 128 * trial for s in sorted(signals) if s // 8 == b]]
        own = got[(got["block"] == b) & (got["trial"] == trial)].sort_values(["hz", "mode"])
        u, s, _ = np.linalg.svd(j.transpose(1, 0, 2), full_matrices=False)
        assert np.allclose(own["value"], s.reshape(-1))
        assert np.allclose(np.stack(own["space"].to_numpy()).reshape(len(s), s.shape[1], -1)[:, 0], np.abs(u[:, :, 0]), atol=1e-6)


def matrices(signals):
    out = {}
    for b in sorted({s // 8 for s in signals}):
        some = [j for (c, _), j in blocks(signals).items() if c == b]
        all_ = np.concatenate(some, 2)
        out[b] = np.einsum("aik,bik->iab", all_.conj(), all_) / all_.shape[2]
    return out


def test_coherence_matrix(spark, signals):
    got = mq.m10(spark, SF).toPandas()
    leading = mq.m11(spark, SF).toPandas()
    for b, s in matrices(signals).items():
        own = got[got["block"] == b].sort_values(["hz", "a", "b"])
        root = np.sqrt(np.einsum("iaa->ia", s).real)
        c = s / (root[:, :, None] * root[:, None, :])
        assert np.allclose(own["coherence"].to_numpy(), np.abs(c).reshape(-1)) and np.allclose(np.exp(1j * own["phase"].to_numpy()), np.exp(1j * np.angle(c)).reshape(-1), atol=1e-5)
        u, w, _ = np.linalg.svd(s)
        rows = leading[leading["block"] == b].sort_values("hz")
        assert np.allclose(rows["total"], w[:, 0] / w.sum(1)) and np.allclose(rows["evenness"], np.exp(np.log(w).mean(1)) / w.mean(1))
        assert np.allclose(np.stack(rows["leading"].to_numpy()), np.abs(u[:, :, 0]), atol=1e-6)


def plain_index(x, nw=3, order=6):
    """By the definition, place by place."""
    n = len(x)
    kernel = np.array([[(2 * nw / n if a == b else math.sin(2 * math.pi * nw * (a - b) / n) / (math.pi * (a - b))) for b in range(n)] for a in range(n)])
    values, vectors = np.linalg.eigh(n * kernel**2)
    v = math.sqrt(n) * vectors[:, ::-1][:, : 4 * nw]
    for k in range(4 * nw):
        if sum((n - 1 - 2 * i) * v[i, k] for i in range(n)) < 0:
            v[:, k] = v[::-1, k]
    tapers = slepian(n, nw, 2 * nw)
    share = [tapers[k] @ kernel @ tapers[k] for k in range(2 * nw)]
    out = []
    for f in range(n // 2 + 1):
        j = np.array([sum(tapers[k, i] * x[i] * np.exp(-2j * np.pi * f * i / n) for i in range(n)) for k in range(2 * nw)])
        total = 0.0
        for m in range(order):
            a = np.array([[math.sqrt(share[p] * share[q]) * (tapers[p] * tapers[q] * v[:, m]).sum() for q in range(2 * nw)] for p in range(2 * nw)])
            weight = np.trace(a @ a)
            c = (j.conj() @ a @ j).real / weight
            total += weight * (c / (np.abs(j) ** 2).mean() - v[:, m].mean()) ** 2
        out.append(total)
    return np.array(out)


def test_index_by_definition():
    x = np.random.default_rng(1).normal(size=64)
    assert np.allclose(quadratic.index(x), plain_index(x))


def test_index_is_raised_by_change():
    draw = np.random.default_rng(2)
    flat = np.array([quadratic.index(draw.normal(size=256))[8:-8].mean() for _ in range(40)])
    swell = np.array([quadratic.index(draw.normal(size=256) * np.where(np.arange(256) < 128, 0.2, 1.8))[8:-8].mean() for _ in range(40)])
    assert swell.mean() > 1.5 * flat.mean() and flat.std() < 0.5 * (swell.mean() - flat.mean())
    assert (quadratic.index(np.zeros(256)) == 0).all()


def test_change_query(spark, signals):
    got = mq.m12(spark, SF).toPandas()
    want = {(sid, s) for sid, x in signals.items() for s in range(0, len(x) - 255, 128)}
    assert set(zip(got["sid"], got["start"])) == want and len(got) == 129 * len(want)
    sid = min(signals)
    own = got[(got["sid"] == sid) & (got["start"] == 128)].sort_values("hz")
    assert np.allclose(own["change"], quadratic.index(signals[sid][128:384])) and np.allclose(own["hz"], np.arange(129) * 1000 / 256)


def plain_match(t, x, start, margin, penalty):
    """Length and distance of the best match from one start, cell by cell."""
    n, m = t.shape[1], x.shape[1]
    cost, best = {}, (math.inf, 0)
    for i in range(n):
        for j in range(max(0, i - margin), i + margin + 1):
            if start + j >= m:
                continue
            ways = [0.0] if i == j == 0 else [cost.get((i - 1, j - 1), math.inf), cost.get((i - 1, j), math.inf) + penalty, cost.get((i, j - 1), math.inf) + penalty]
            cost[i, j] = min(ways) + float(((t[:, i] - x[:, start + j]) ** 2).sum())
            if i == n - 1 and cost[i, j] < best[0]:
                best = cost[i, j], j + 1
    return best[1], math.sqrt(best[0])


def test_every_start():
    draw = np.random.default_rng(3)
    for n, m, margin in ((6, 40, 2), (5, 12, 5), (4, 5, 0), (8, 3, 2), (1, 6, 1)):
        t, x = draw.normal(size=(3, n)), draw.normal(size=(3, m))
        length, far = regions.from_every_start(t, x, m, margin, 0.7)
        want = [plain_match(t, x, s, margin, 0.7) for s in range(m)]
        assert length.tolist() == [w[0] for w in want] and np.allclose(far, [w[1] for w in want])


def test_planted_region():
    draw = np.random.default_rng(4)
    t = draw.normal(size=(4, 20))
    x = draw.normal(size=(4, 300))
    x[:, 100:122] = np.repeat(t, [1] * 5 + [2] * 2 + [1] * 13, axis=1)
    length, far = regions.from_every_start(t, x, 300, 5, 0.1)
    assert far.argmin() == 100 and length[100] == 22 and abs(far[100] - math.sqrt(0.2)) < 1e-9


def songs():
    v = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x = np.stack(v["embedding"].to_numpy()).astype(float)
    series = {s: np.concatenate([10 * r.reshape(4, 16) for r in x[v["vec_id"] // 8 == s]], 1) for s in sorted(set(v["vec_id"] // 8))}
    return series, {int(k): 10 * x[v["label"] == k].mean(0).reshape(4, 16) for k in sorted(set(v["label"]))}


def test_best_regions(spark):
    series, templates = songs()
    got = {(r.series, r.template): (r.start, r.stop, r.distance) for r in mq.k13(spark, SF).collect()}
    assert set(got) == {(s, k) for s in series for k in templates}
    for s in list(series)[:4]:
        for k in list(templates)[:3]:
            tries = [(far, start, start + length) for start in range(series[s].shape[1]) for length, far in [plain_match(templates[k], series[s], start, regions.MARGIN, regions.PENALTY)] if length]
            far, start, stop = min(tries)
            assert got[s, k][:2] == (start, stop) and abs(got[s, k][2] - far) < 1e-6
    agreed = {r.series: r for r in mq.k14(spark, SF).collect()}
    s = min(series)
    assert np.isclose(agreed[s].start, np.mean([got[s, k][0] for k in templates])) and np.isclose(agreed[s].score, np.mean([got[s, k][2] for k in templates])) and agreed[s].templates == len(templates)


def test_chunks_have_what_they_need(spark):
    """Small chunks give what one large one does."""
    draw = np.random.default_rng(5)
    x = {s: draw.normal(size=(2, 90 + 7 * s)) for s in range(3)}
    frames = spark.createDataFrame([(s, k, [float(v) for v in x[s][:, k]]) for s in x for k in range(x[s].shape[1])], "series long, k long, v array<double>")
    t = [(7, draw.normal(size=(2, 9)))]
    rows = [sorted(map(tuple, regions.scored(frames, t, chunk=c).collect())) for c in (16, 4096)]
    assert rows[0] == rows[1] and len(rows[0]) == sum(v.shape[1] - 9 + regions.MARGIN + 1 for v in x.values())


def test_dips(spark):
    got = mq.k15(spark, SF).toPandas()
    scores = regions.scored(mq.song(spark, SF), mq.examples(spark, SF)).toPandas()
    s, k = int(got["series"].iloc[0]), int(got["template"].iloc[0])
    own = scores[(scores["series"] == s) & (scores["template"] == k)]
    want = [r.start for r in own.itertuples() if all((r.distance, r.start) <= (q.distance, q.start) for q in own.itertuples() if abs(q.start - r.start) <= 8)]
    assert sorted(got[(got["series"] == s) & (got["template"] == k)]["start"]) == sorted(want)
