"""File sources, table functions and reductions."""

import struct

import numpy as np
import pytest

from intervalia.functions import reductions
from intervalia.sources import files, wav


def wav_file(x, rate, bits=16, code=1, before=b"", cut=0):
    """A WAV file of samples (frames by channels) by its definition."""
    frames, channels = x.shape
    if code == 3:
        body = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (x * 128 + 128).astype(np.uint8).tobytes()
    else:
        body = b"".join(int(v * 2 ** (bits - 1)).to_bytes(bits // 8, "little", signed=True) for v in x.ravel())
    head = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    data = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + before + b"fmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body
    return data[: len(data) - cut]


def written(folder, x, **options):
    folder.parent.mkdir(parents=True, exist_ok=True)
    folder.write_bytes(wav_file(x, **options))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    draw = np.random.default_rng(1)
    base = tmp_path_factory.mktemp("sound")
    x = {}
    for name, frames, channels, options in [("a.wav", 1000, 1, {}), ("sub/b.WAV", 777, 2, {"bits": 24}), ("c.wav", 50, 1, {"bits": 8}), ("d.wav", 300, 3, {"bits": 32, "code": 3}), ("e.wav", 0, 1, {}), ("f.wav", 10, 2, {"bits": 64, "code": 3, "before": b"LIST" + struct.pack("<I", 3) + b"abc\0"}), ("g.wav", 100, 1, {"bits": 32})]:
        scale = 2 ** (options.get("bits", 16) - 1)
        y = draw.uniform(-1, 1, (frames, channels))
        x[name] = y.astype("<f4").astype(float) if options.get("code") == 3 and options["bits"] == 32 else y if options.get("code") == 3 else np.trunc(y * scale) / scale
        written(base / name, x[name], rate=8000 + len(name), **options)
    written(base / "cut.wav", x["a.wav"], rate=9000, cut=101)
    x["cut.wav"] = x["a.wav"][:949]
    (base / "notes.txt").write_text("not sound")
    (base / "_SUCCESS.wav").write_text("")
    return base, x


@pytest.mark.parametrize("options", [{}, {"chunk": 64, "partbytes": 100}, {"chunk": 7, "partbytes": 333}])
def test_wav_folder(spark, folder, options):
    base, x = folder
    files.register(spark)
    got = spark.read.format("wav").options(**options).load(str(base)).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.frames == len(x[r.file]) and r.rate == (9000 if r.file == "cut.wav" else 8000 + len(r.file))
        assert r.start == len(found.setdefault((r.file, r.channel), []))
        found[r.file, r.channel] += r.x
    assert set(found) == {(n, k) for n, y in x.items() for k in range(y.shape[1]) if len(y)}
    for (name, k), y in found.items():
        assert np.allclose(y, x[name][:, k], atol=1e-9)


def test_filters_are_taken_over(spark, folder):
    base, x = folder
    reader = files.WavReader({"path": str(base), "chunk": "64"})
    from pyspark.sql import datasource as ds

    left = list(reader.pushFilters([ds.EqualTo(("file",), "a.wav"), ds.GreaterThanOrEqual(("start",), 128), ds.LessThan(("start",), 256), ds.EqualTo(("rate",), 8000), ds.StringStartsWith(("file",), "a")]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "StringStartsWith"]
    assert [f for p in reader.partitions() for f, *_ in p.files] == ["a.wav"]
    assert [b.column("start").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[128], [192]]
    files.register(spark)
    df = spark.read.format("wav").option("chunk", 64).load(str(base))
    got = df.where("file IN ('a.wav', 'd.wav') AND channel = 0 AND start > 64 AND start <= 192").collect()
    assert sorted((r.file, r.start) for r in got) == [("a.wav", 128), ("a.wav", 192), ("d.wav", 128), ("d.wav", 192)]
    assert df.where("file = 'none.wav'").count() == 0


def test_written_and_read(spark, tmp_path):
    files.register(spark)
    draw = np.random.default_rng(2)
    x = {f"{k}.wav": draw.uniform(-1.2, 1.2, 50 + k) for k in range(5)}
    rows = spark.createDataFrame([(n, 4000, y.tolist()) for n, y in x.items()], "file string, rate int, x array<double>").repartition(3)
    path = str(tmp_path / "out")
    for mode in ("append", "overwrite"):
        rows.write.format("wav").mode(mode).save(path)
    for r in spark.read.format("wav").load(path).collect():
        assert r.rate == 4000 and np.allclose(r.x, np.clip(x[r.file], -1, 32767 / 32768), atol=1 / 65536 + 1e-12)
    one = spark.read.format("wav").load(path + "/3.wav").collect()
    assert len(one) == 1 and one[0].file == "" and len(one[0].x) == 53
    assert wav.read_wav(spark, path).count() == 5


def test_bad_files(tmp_path):
    import io

    for data in (b"", b"RIFF0000WAVE", b"RIFF0000WAVEfmt \x10\0\0\0" + struct.pack("<HHIIHH", 7, 1, 1, 1, 1, 8) + b"data\0\0\0\0"):
        with pytest.raises(ValueError):
            files.wav_head(io.BytesIO(data), len(data))


def test_recordings(spark, tmp_path):
    files.register(spark)
    (tmp_path / "a.txt").write_text("% <name> <depth> <note>\nbird1 1.5 x % a comment\n% all comment\nbird2\t2e1 7\n")
    (tmp_path / "b.txt").write_text("1 2\n3 4\n5 x\n")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.txt").write_text("% no names\n1 2\n")
    got = spark.read.format("recording").load(str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("a.txt", 0, "name", "bird1", None), ("a.txt", 1, "name", "bird2", None), ("a.txt", 0, "depth", "1.5", 1.5), ("a.txt", 1, "depth", "2e1", 20.0), ("a.txt", 0, "note", "x", None), ("a.txt", 1, "note", "7", None)]
        + [("b.txt", k, "Field1", str(2 * k + 1), 2.0 * k + 1) for k in range(3)] + [("b.txt", 0, "Field2", "2", None), ("b.txt", 1, "Field2", "4", None), ("b.txt", 2, "Field2", "x", None)],
        key=str,
    )
    only = spark.read.format("recording").load(str(tmp_path)).where("file = 'a.txt' AND field = 'depth'").collect()
    assert [r.number for r in sorted(only, key=lambda r: r.row)] == [1.5, 20.0]


def test_table_functions(spark):
    assert {"dips", "grams", "split_overlapping", "activity_fraction", "median_deviation", "spread_of"} <= set(reductions.register(spark, {"spread_of": lambda x: float(x.max() - x.min())}))
    got = spark.sql("SELECT * FROM split_overlapping(0, 10, 4, 0.5D)").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 4.0), (2, 2.0, 6.0), (3, 4.0, 8.0), (4, 6.0, 10.0)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM grams(array('a', 'b', 'a'), 2)").collect()] == [(1, "a b"), (2, "b a")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM dips(array(3D, 1D, 1D, 2D, 0D), 1.5D)").collect()] == [(2, 1.0), (5, 0.0)]
    assert spark.sql("SELECT * FROM grams(CAST(NULL AS array<string>), 2)").count() == 0
    x = spark.createDataFrame([(1, 1.0), (1, 5.0), (2, 2.0), (2, None), (3, None)], "k int, v double")
    x.createOrReplaceTempView("xs")
    rows = {r.k: r for r in spark.sql("SELECT k, activity_fraction(v) AS a, median_deviation(v) AS m, spread_of(v) AS s FROM xs GROUP BY k").collect()}
    assert np.isclose(rows[1].a, 9 / 13) and rows[1].m == 2.0 and rows[1].s == 4.0 and rows[2].a == 1.0 and (rows[3].a is None or np.isnan(rows[3].a))


def test_summed_reductions(spark):
    draw = np.random.default_rng(3)
    x = [(k % 3, float(v)) for k, v in enumerate(draw.gamma(2.0, size=3000))] + [(5, 1.0), (None, 1.0), (1, None)]
    got = {r.key: r for r in reductions.reduced(spark.createDataFrame(x, "key int, v double").repartition(7), "key", "v", reductions.SHAPE).collect()}
    assert set(got) == {0, 1, 2, 5} and got[5].sd == 0.0 and got[5].skew is None
    for k in range(3):
        y = np.array([v for i, v in x if i == k and v is not None])
        z = (y - y.mean()) / y.std()
        assert (got[k].n, round(got[k].mean, 9)) == (1000, round(y.mean(), 9)) and np.isclose(got[k].skew, (z**3).mean()) and np.isclose(got[k].kurtosis, (z**4).mean())
