"""Queries of signal processing, segmentation and warping; beyond SQL, tests compare them with direct forms (S, D, G, A, P)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.operators import dsp, offsets, tiles, warp
from intervalia.operators.measures import reductions
from intervalia.plans.registry import query
from intervalia.sources import wav
from intervalia.sources.fixtures import FS, signals, vectors

#: Window and step of the spectra, in seconds; size and step of short-time transforms, in samples.
WINDOW, STEP, SIZE, HOP = 0.064, 0.016, 64, 16


def each_signal(rows: DataFrame, f, schema: str) -> DataFrame:
    """f(sid, x) gives a frame for each signal, one at a time in a task; signals too short for a window give none."""

    def run(batches):
        for b in batches:
            for sid, x in zip(b["sid"], b["x"]):
                if len(x) >= 2 * SIZE:
                    yield f(int(sid), np.asarray(x, float))

    return rows.select("sid", "x").mapInPandas(run, schema)


def grid(sid: int, times: np.ndarray, f: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
    """A row for each time and frequency."""
    return pd.DataFrame({"sid": sid, "t": np.repeat(times, len(f)), "hz": np.tile(f, len(times))} | {k: v.reshape(-1) for k, v in values.items()})


def curve(sid: int, times: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"sid": sid, "t": times} | values)


@query("s01_wav_round_trip")
def s01(spark, d):
    """Signals as WAV bytes and back: what a file of them would hold."""

    def each(batches):
        for b in batches:
            for sid, data in zip(b["sid"], b["data"]):
                rate, x = wav.decoded(bytes(data))
                yield pd.DataFrame({"sid": [sid], "rate": [rate], "length": [len(x)], "mean": [x[:, 0].mean()], "peak": [np.abs(x[:, 0]).max()]})

    return wav.wav_bytes(signals(spark, d), int(FS)).mapInPandas(each, "sid long, rate int, length long, mean double, peak double")


def sampled(x: np.ndarray, sid: int) -> pd.DataFrame:
    return pd.DataFrame({"sid": sid, "k": np.arange(1, len(x) + 1), "y": x})


@query("d02_high_pass")
def d02(spark, d):
    return each_signal(signals(spark, d), lambda sid, x: sampled(dsp.high_pass(x, FS, 50.0), sid), "sid long, k int, y double")


@query("d03_low_pass")
def d03(spark, d):
    return each_signal(signals(spark, d), lambda sid, x: sampled(dsp.low_pass(x, FS, 100.0), sid), "sid long, k int, y double")


@query("d04_clip_and_process")
def d04(spark, d):
    """A padded clip of each signal, gated, high-passed and low-passed."""

    def one(sid, x):
        clip = x[64 - 32 : min(len(x), 320 + 32)]
        floor = np.quantile(np.abs(dsp.short_time(x, SIZE, HOP, SIZE)) ** 2, 0.3, axis=0)
        clean = dsp.noise_gate(clip, FS, floor, SIZE, HOP)
        return sampled(dsp.low_pass(dsp.high_pass(clean, FS, 20.0), FS, 400.0), sid)

    return each_signal(signals(spark, d), one, "sid long, k int, y double")


@query("d05_noise_gate")
def d05(spark, d):
    def one(sid, x):
        floor = np.quantile(np.abs(dsp.short_time(x, SIZE, HOP, SIZE)) ** 2, 0.5, axis=0)
        return sampled(dsp.noise_gate(x, FS, floor, SIZE, HOP), sid)

    return each_signal(signals(spark, d), one, "sid long, k int, y double")


@query("d08_inverse_spectrogram")
def d08(spark, d):
    return each_signal(signals(spark, d), lambda sid, x: sampled(dsp.overlap_added(dsp.short_time(x, SIZE, HOP, 2 * SIZE), SIZE, HOP, 2 * SIZE), sid), "sid long, k int, y double")


@query("d09_multitaper_spectrogram")
def d09(spark, d):
    def one(sid, x):
        p, t, f = dsp.multitaper(x, FS, WINDOW, STEP)
        return grid(sid, t, f, power=p)

    return each_signal(signals(spark, d), one, "sid long, t double, hz double, power double")


@query("d10_derivative_spectrogram")
def d10(spark, d):
    def one(sid, x):
        s, t, f = dsp.derivative(x, FS, WINDOW, STEP)
        return grid(sid, t, f, time=s[0], frequency=s[1])

    return each_signal(signals(spark, d), one, "sid long, t double, hz double, time double, frequency double")


def statistics(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Times and the curves of one spectrum: power, entropy, centre, modulations, pitch and periodicity."""
    p, t, f = dsp.multitaper(x, FS, WINDOW, STEP)
    s, _, _ = dsp.derivative(x, FS, WINDOW, STEP)
    total = p.sum(1)
    goodness, harmonic = dsp.harmonic_pitch(s[0], FS)
    apart, pitch = dsp.yin(x, FS, 20.0, 400.0, SIZE, HOP)
    at = (SIZE / 2 + HOP * np.arange(len(pitch))) / FS
    good = ~np.isnan(pitch)
    fundamental = np.interp(t, at[good], pitch[good], left=100.0, right=100.0) if good.any() else np.full(len(t), 100.0)
    return t, {
        "power": total, "entropy": np.log(p + 1e-12).mean(1) - np.log(p.mean(1) + 1e-12), "centre": (p * f).sum(1) / np.maximum(total, 1e-12),
        "fm": np.degrees(np.arctan2((s[0] ** 2).max(1), (s[1] ** 2).max(1))), "am": -s[0].sum(1) / np.maximum(total, 1e-12) / (STEP * 1000),
        "goodness": goodness, "harmonic": harmonic, "fundamental": fundamental, "aperiodicity": np.interp(t, at, apart, left=1.0, right=1.0),
    }


CURVES = ("power", "entropy", "centre", "fm", "am", "goodness", "harmonic", "fundamental", "aperiodicity")
CURVE_SCHEMA = "sid long, t double, " + ", ".join(f"{c} double" for c in CURVES)


@query("d11_spectrum_statistics")
def d11(spark, d):
    def one(sid, x):
        t, curves = statistics(x)
        return curve(sid, t, **curves)

    return each_signal(signals(spark, d), one, CURVE_SCHEMA)


@query("d16_harmonic_pitch")
def d16(spark, d):
    return d11(spark, d).select("sid", "t", "goodness", "harmonic")


@query("d17_periodicity")
def d17(spark, d):
    def one(sid, x):
        apart, pitch = dsp.yin(x, FS, 20.0, 400.0, SIZE, HOP)
        return curve(sid, (SIZE / 2 + HOP * np.arange(len(pitch))) / FS, aperiodicity=apart, pitch=np.where(np.isnan(pitch), 100.0, pitch))

    return each_signal(signals(spark, d), one, "sid long, t double, aperiodicity double, pitch double")


def mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cepstra (13, windows) by filters that fit the rate of the signals, and times."""
    p, t, f = dsp.multitaper(x, FS, WINDOW, STEP)
    return dsp.cepstra(p, f, lowest=20.0, spacing=12.0, linear=13, log=14, ratio=1.07), t


@query("d18_cepstra")
def d18(spark, d):
    def one(sid, x):
        c, t = mel(x)
        return pd.DataFrame({"sid": sid, "t": np.repeat(t, len(c)), "c": np.tile(np.arange(len(c)), len(t)), "value": c.T.reshape(-1)})

    return each_signal(signals(spark, d), one, "sid long, t double, c int, value double")


@query("d19_two_taper_features")
def d19(spark, d):
    """The same family from two fixed tapers: amplitude in dB, entropy, centre and cepstral pitch."""

    def one(sid, x):
        p, t, f = dsp.multitaper(x, FS, WINDOW, STEP, 1.5, 2)
        loud = np.log(p + 1e-12)
        cepstrum = np.abs(np.fft.rfft(loud - loud.mean(1, keepdims=True), axis=1))[:, 1:]
        total = p.sum(1)
        return curve(sid, t, amplitude=10 * np.log10(total + 1e-12), entropy=loud.mean(1) - np.log(p.mean(1) + 1e-12), centre=(p * f).sum(1) / np.maximum(total, 1e-12), pitch=FS / (1.0 + cepstrum.argmax(1)))

    return each_signal(signals(spark, d), one, "sid long, t double, amplitude double, entropy double, centre double, pitch double")


# segmentation


def spans(sid: int, found: list[tuple[float, float]]) -> pd.DataFrame:
    return pd.DataFrame({"sid": [sid] * len(found), "start": [a for a, _ in found], "stop": [b for _, b in found]}).astype({"sid": "int64", "start": "float64", "stop": "float64"})


SPANS = "sid long, start double, stop double"


@query("g01_stepped_sounds")
def g01(spark, d):
    """Sounds of overlapping windows of a signal, put back to its times and merged where they meet."""

    def one(sid, x):
        found = []
        for begin in range(0, max(1, len(x) - 256 + 1), 192):
            part = dsp.high_pass(x[begin : begin + 256], FS, 20.0)
            p, t, _ = dsp.multitaper(part, FS, WINDOW, STEP, 1.0, 1)
            loud = np.concatenate(([False], p.sum(1) > np.median(p.sum(1)), [False]))
            edge = np.flatnonzero(np.diff(loud.astype(int)))
            found += [(begin / FS + t[a], begin / FS + t[b - 1]) for a, b in zip(edge[::2], edge[1::2])]
        merged: list[list[float]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return spans(sid, [(a, b) for a, b in merged])

    return each_signal(signals(spark, d), one, SPANS)


def cut(x: np.ndarray) -> list[tuple[float, float]]:
    p, t, _ = dsp.multitaper(x, FS, WINDOW, STEP, 1.0, 1)
    total = np.convolve(p.sum(1), np.ones(3) / 3, "same") + 1e-12
    return dsp.syllables(total, t, flat=1.2, rise=0.0, amp=1.1, power=float(np.quantile(total, 0.5)))


@query("g03_syllables")
def g03(spark, d):
    return each_signal(signals(spark, d), lambda sid, x: spans(sid, cut(x)), SPANS)


@query("g04_syllables_with_features")
def g04(spark, d):
    """Filtered, cut into syllables, near ones joined, short ones left out, with the mean of each curve inside."""

    def one(sid, x):
        y = dsp.low_pass(dsp.high_pass(x, FS, 20.0), FS, 400.0)
        joined: list[list[float]] = []
        for a, b in cut(y):
            if joined and a - joined[-1][1] <= 0.01:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        t, curves = statistics(y)
        rows = [[sid, a, b, *[float(c[(t >= a) & (t <= b)].mean()) for c in curves.values()]] for a, b in joined if b - a >= 0.02]
        return pd.DataFrame(rows, columns=["sid", "start", "stop", *CURVES]).astype({"sid": "int64"} | {c: "float64" for c in ("start", "stop", *CURVES)})

    return each_signal(signals(spark, d), one, SPANS + ", " + ", ".join(f"{c} double" for c in CURVES))


@query("g06_widened_borders")
def g06(spark, d):
    def one(sid, x):
        p, t, _ = dsp.multitaper(x, FS, WINDOW, STEP, 1.0, 1)
        loud = p.sum(1) > np.quantile(p.sum(1), 0.6)
        place = {v: k for k, v in enumerate(t)}
        found = [dsp.widened(loud, place[a], place[b] + 1, 1, 2) for a, b in cut(x)]
        return spans(sid, [(float(t[a]), float(t[b - 1])) for a, b in found])

    return each_signal(signals(spark, d), one, SPANS)


@query("a02_signal_features")
def a02(spark, d):
    """The ten reductions of every curve of every signal."""
    x = d11(spark, d)
    long = x.select("sid", "t", F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(c).alias("x")) for c in CURVES])).alias("e")).select("sid", "t", "e.*")
    rows = long.select(F.concat_ws(":", "sid", "curve").alias("vec_id"), F.round(F.col("t") * FS).cast("int").alias("k"), "x")
    out = reductions(rows)
    return out.select(F.split("vec_id", ":")[0].cast("long").alias("sid"), F.split("vec_id", ":")[1].alias("curve"), *[c for c in out.columns if c != "vec_id"])


@query("a03_short_filter_features")
def a03(spark, d):
    """Features of signals that pass a length filter after a high pass."""
    x = signals(spark, d).where(F.size("x") >= 4 * SIZE)

    def one(sid, x):
        t, curves = statistics(dsp.high_pass(x, FS, 20.0))
        return pd.DataFrame([[sid, len(x) / FS, *[float(np.mean(c)) for c in curves.values()]]], columns=["sid", "length", *CURVES])

    return each_signal(x, one, "sid long, length double, " + ", ".join(f"{c} double" for c in CURVES))


# warped distances: vectors as 4 features by 16 frames


@query("p04_time_warp")
def p04(spark, d):
    return tiles.pairs(vectors(spark, d), lambda a, b: warp.each_pair(10 * a, 10 * b, 4), False).select("i", "j", F.round("d", 9).alias("d"))


@query("p05_length_normalised_warp")
def p05(spark, d):
    """Series of 11 to 16 frames; the distance over the mean length of the pair in seconds."""
    v = vectors(spark, d)
    return tiles.tiled(v.select("vec_id", "v"), "vec_id", lambda a, b, same: _ragged(a, b, same), "i long, j long, d double")


def _ragged(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
    shaped = [[(int(k), (10 * np.asarray(v)).reshape(4, -1)[:, : 16 - int(k) % 6]) for k, v in zip(x["vec_id"], x["v"])] for x in (a, b)]
    return warp.ragged(*shaped, same=same, interval=1 / FS)


@query("p06_cepstral_warp")
def p06(spark, d):
    """Warped distances of the cepstra of signals, over windows of a signal."""

    def one(sid, x):
        return pd.DataFrame({"vec_id": [sid], "v": [mel(x)[0].reshape(-1)]})

    c = each_signal(signals(spark, d).where(F.size("x") == 512), one, "vec_id long, v array<double>").withColumn("label", F.lit(0))
    return tiles.pairs(c, lambda a, b: warp.each_pair(a, b, 13), False).select("i", "j", F.round("d", 9).alias("d"))


@query("p18_distance_panel")
def p18(spark, d):
    """Offset reductions, warp and plain distance of every pair, side by side."""
    return panel(vectors(spark, d))


def panel(v: DataFrame) -> DataFrame:
    """All in one pass over the tiles, so that no table of pairs is joined with another."""
    columns = ["distance", "mean", "most", "least", "median", "rms", "warped", "euclidean"]

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        i, j = np.nonzero(a["vec_id"].to_numpy()[:, None] < b["vec_id"].to_numpy())
        out = offsets.reduced(a, b).iloc[i * len(b) + j][["i", "j", *columns[:6]]]
        parts = [slice(k, k + tiles.AT_ONCE) for k in range(0, len(i), tiles.AT_ONCE)]
        warped = [warp.each_pair(10 * x[i[p]], 10 * y[j[p]], 4) for p in parts]
        return out.assign(warped=np.concatenate([np.zeros(0), *warped]), euclidean=tiles.euclidean(x, y)[i, j])

    def each(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        done = [one(x, y) for x, y in ([(a, b)] if same else [(a, b), (b, a)]) if len(x) and len(y)]
        return pd.concat(done) if done else pd.DataFrame({c: [] for c in ["i", "j", *columns]}).astype({"i": "int64", "j": "int64"})

    return tiles.tiled(v.where("v IS NOT NULL").select("vec_id", "v", "label"), "vec_id", each, "i long, j long, " + ", ".join(f"{c} double" for c in columns))


@query("d23_local_detrend")
def d23(spark, d):
    """Signals less their running linear fit."""
    return each_signal(signals(spark, d), lambda sid, x: sampled(x - dsp.local_line(x, 100, 50), sid), "sid long, k int, y double")


@query("d29_running_line")
def d29(spark, d):
    """The running linear fit itself: lines through windows of 100 samples, 50 apart, blended."""
    return each_signal(signals(spark, d), lambda sid, x: sampled(dsp.local_line(x, 100, 50), sid), "sid long, k int, y double")


@query("m01_series_spectrum")
def m01(spark, d):
    """The multitaper spectrum of whole signals."""

    def one(sid, x):
        j, f = dsp.series_transform(x, FS)
        return pd.DataFrame({"sid": sid, "hz": f, "power": (np.abs(j) ** 2).mean(0)})

    return each_signal(signals(spark, d), one, "sid long, hz double, power double")


@query("m02_line_test")
def m02(spark, d):
    """F of a sine wave at each frequency of a signal."""

    def one(sid, x):
        v, amplitude, f = dsp.line_test(x, FS)
        return pd.DataFrame({"sid": sid, "hz": f, "F": v, "amplitude": amplitude})

    return each_signal(signals(spark, d), one, "sid long, hz double, F double, amplitude double")


def neighbours(spark, d) -> DataFrame:
    """sid, x and y: each signal and the one after it, of one length."""
    s = signals(spark, d)
    after = s.select((F.col("sid") - 1).alias("sid"), F.col("x").alias("y"))
    return s.join(after, "sid").where(F.size("x") == F.size("y"))


@query("m03_coherence")
def m03(spark, d):
    def run(batches):
        for b in batches:
            for sid, x, y in zip(b["sid"], b["x"], b["y"]):
                c, phase, f = dsp.coherence(np.asarray(x), np.asarray(y), FS)
                yield pd.DataFrame({"sid": int(sid), "hz": f, "coherence": c, "phase": phase})

    return neighbours(spark, d).mapInPandas(run, "sid long, hz double, coherence double, phase double")


@query("m04_segment_spectra")
def m04(spark, d):
    """The mean spectrum of the segments of each signal."""

    def one(sid, x):
        parts = [dsp.series_transform(x[k : k + 128], FS) for k in range(0, len(x) - 127, 128)]
        return pd.DataFrame({"sid": sid, "hz": parts[0][1], "power": np.mean([(np.abs(j) ** 2).mean(0) for j, _ in parts], 0), "segments": len(parts)})

    return each_signal(signals(spark, d), one, "sid long, hz double, power double, segments int")


@query("q16_two_group_spectrum")
def q16(spark, d):
    """Normal deviate of the log spectra of each signal and the next."""

    def run(batches):
        for b in batches:
            for sid, x, y in zip(b["sid"], b["x"], b["y"]):
                (p, f), (q, _) = dsp.series_transform(np.asarray(x), FS), dsp.series_transform(np.asarray(y), FS)
                yield pd.DataFrame({"sid": int(sid), "hz": f, "z": dsp.two_spectra(p, q)})

    return neighbours(spark, d).mapInPandas(run, "sid long, hz double, z double")
