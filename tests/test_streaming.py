"""Streams against the batch operators, and functions from SQL."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from intervalia.functions.register import register
from intervalia.operators import dsp, warp
from intervalia.streaming import sessions


def events(n=400):
    r = random.Random(3)
    t = datetime.datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        t += datetime.timedelta(seconds=r.randint(1, 240))
        rows.append((r.randrange(4), r.choice("abc"), t, t + datetime.timedelta(seconds=r.randint(1, 300))))
    return rows


SCHEMA = "series long, type string, start timestamp, stop timestamp"


def run(spark, tmp_path, build, rows, name):
    """The rows in five files, one for each trigger, and an event a day later that moves the watermark past them."""
    last = max(x[2] for x in rows) + datetime.timedelta(days=1)
    parts = [rows[k::1][: len(rows) // 5] for k in range(0, len(rows), len(rows) // 5)] + [[(99, "a", last, last)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{k}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return [r for r in spark.table(name).collect() if r[0] != 99]


def test_bouts_and_counts(spark, tmp_path):
    rows = events()
    got = run(spark, tmp_path, lambda s: sessions.bouts(s, "10 minutes", "1 hour"), rows, "bouts")
    want = []
    for series in range(4):
        own = sorted(x for x in rows if x[0] == series)
        own.sort(key=lambda x: x[2])
        for _, _, a, b in own:
            if want and want[-1][0] == series and (a - want[-1][4]).total_seconds() < 600:
                want[-1] = (series, want[-1][1], max(b, want[-1][2]), want[-1][3] + 1, a)
            else:
                want.append((series, a, b, 1, a))
    assert sorted(map(tuple, got)) == sorted(x[:4] for x in want)
    got = run(spark, tmp_path, lambda s: sessions.counts(s, "1 hour", "1 hour"), rows, "counts")
    batch = spark.createDataFrame(rows, SCHEMA).groupBy("series", "type", F.window("start", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(F.unix_seconds("stop") - F.unix_seconds("start")).alias("s"))
    assert sorted((r.series, r.type, r.start, r.n, r.seconds) for r in got) == sorted((r.series, r.type, r.w.start, r.n, float(r.s)) for r in batch.collect())


def test_overlaps_and_transitions(spark, tmp_path):
    rows = events(200)
    got = run(spark, tmp_path, lambda s: sessions.overlapping(s.where("type = 'a'"), s.where("type = 'b'"), "10 minutes", "1 hour"), rows, "overlaps")
    want = [(x[0], x[2], x[3], y[2], y[3]) for x in rows for y in rows if x[0] == y[0] and x[1] == "a" and y[1] == "b" and x[2] < y[3] and y[2] < x[3]]
    assert sorted(map(tuple, got)) == sorted(want)
    found: dict = {}
    for r in run(spark, tmp_path, sessions.transitions, rows, "transitions"):
        found[r.series, r.before, r.after] = found.get((r.series, r.before, r.after), 0) + r.n
    plain: dict = {}
    for series in range(4):
        own = [x[1] for x in sorted(rows, key=lambda x: x[2]) if x[0] == series]
        for a, b in zip(own, own[1:]):
            plain[series, a, b] = plain.get((series, a, b), 0) + 1
    assert found == plain


def test_functions(spark):
    assert {"warp_distance", "low_pass", "high_pass", "power_curve"} <= set(register(spark))
    x, y = np.random.default_rng(1).normal(size=(2, 64))
    spark.createDataFrame([(x.tolist(), y.tolist()), (None, y.tolist())], "x array<double>, y array<double>").createOrReplaceTempView("two")
    got = spark.sql("SELECT warp_distance(x, y, 4) AS d, low_pass(x, 1000D, 100D) AS l, power_curve(x, 1000D, 0.032D, 0.016D) AS p FROM two").collect()
    assert abs(got[0].d - warp.warp_block(x.reshape(1, 4, 16), y.reshape(1, 4, 16))[0]) < 1e-12 and got[1].l is None
    assert np.allclose(got[0].l, dsp.low_pass(x, 1000.0, 100.0)) and np.allclose(got[0].p, dsp.multitaper(x, 1000.0, 0.032, 0.016)[0].sum(1))
