"""Standard intervals against plain votes."""

import numpy as np
import pandas as pd

from intervalia.operators import recognition
from intervalia.plans import recognition_queries as rq

SF = "/root/testdata/sf0.001"


def plain(x, songs, step, width, share=0.35):
    """start and stop of the standards of one key, point by point."""
    found = []
    for c in ("start", "stop"):
        t = [v for v in x[c] if v >= 0]
        top = int(max(t) / step) + int(width / step) + 3
        v = [sum(max(0.0, 1 - ((g * step - a) / width) ** 2) for a in t) for g in range(top)]
        tops = [g for g in range(top) if v[g] >= share * songs and (g == 0 and v[g] > 0 or g > 0 and v[g] > v[g - 1]) and g + 1 < top and v[g] > next((w for w in v[g + 1 :] if abs(w - v[g]) > 1e-12), 0)]
        kept = []
        for g in sorted(tops, key=lambda g: (-v[g], g)):
            if all(abs(g - h) > round(width / step) for h in kept):
                kept.append(g)
        found.append(sorted(kept))
    return [(k + 1, a * step, b * step) for k, (a, b) in enumerate(zip(*found)) if b > a]


def test_planted_standards(spark):
    draw = np.random.default_rng(1)
    rows = []
    for song in range(40):
        for k, (a, b) in enumerate([(10.0, 14.0), (30.0, 42.0), (60.0, 63.0)]):
            if draw.random() < 0.8:
                rows.append(("x", len(rows), song, a + draw.normal(0, 0.3), b + draw.normal(0, 0.3)))
        rows.append(("x", len(rows), song, float(draw.uniform(0, 90)), float(draw.uniform(90, 99))))
    df = spark.createDataFrame(rows, "key string, id long, song long, start double, stop double")
    songs = spark.createDataFrame([("x", 40)], "key string, n long")
    got = recognition.standard(df, songs, 0.25, 1.5).collect()
    near = {(round(r.start), round(r.stop)) for r in got}
    assert {(10, 14), (30, 42), (60, 63)} <= near
    x = pd.DataFrame(rows, columns=["key", "id", "song", "start", "stop"])
    want = plain(x, 40, 0.25, 1.5)
    assert [(r.place, r.start, r.stop) for r in sorted(got)] == want
    matched = {r.id: r.place for r in recognition.matched(df, recognition.standard(df, songs, 0.25, 1.5), 1.5).collect()}
    for r in x.itertuples():
        fits = [p for p, a, b in want if abs(r.start - a) < 3 and abs(r.stop - b) < 3]
        assert matched.get(r.id) == (fits[0] if len(fits) == 1 else None)


def test_queries(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    us = e["ts"].astype("datetime64[us]").astype("int64")
    start = (us % rq.DAY_US) / 60e6
    x = pd.DataFrame({"key": e["event_type"], "id": e["event_id"], "song": us // rq.DAY_US, "start": start, "stop": start + (e["value"] * 60e6).round() / 60e6})
    got, match = rq.k18(spark, SF).toPandas(), rq.k19(spark, SF).toPandas()
    for key, own in x.groupby("key"):
        want = plain(own, own["song"].nunique(), rq.STEP, rq.WIDTH)
        found = got[got["key"] == key].sort_values("place")
        assert np.allclose(found[["place", "start", "stop"]].to_numpy(float).reshape(-1, 3), np.array(want, float).reshape(-1, 3))
        fits = {r.id: [p for p, a, b in want if abs(r.start - a) < 60 and abs(r.stop - b) < 60] for r in own.itertuples()}
        assert dict(match[match["key"] == key][["id", "place"]].itertuples(index=False)) == {i: f[0] for i, f in fits.items() if len(f) == 1}


def test_empty(spark):
    none = spark.createDataFrame([], "key string, id long, start double, stop double")
    assert recognition.standard(none, spark.createDataFrame([], "key string, n long"), 1.0, 2.0).count() == 0


def test_peaks():
    g, v = np.arange(8), np.array([1.0, 3, 3, 2, 5, 1, 0, 4])
    assert recognition.peaks_of(g, v, 2.0, 0).tolist() == [1, 4, 7]
    assert recognition.peaks_of(g, v, 2.0, 3).tolist() == [4] and recognition.peaks_of(g, v, 4.5, 0).tolist() == [4]
