"""WAV files as a source and a sink: PCM of 8 to 32 bits and floats, without a library, by their chunks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(data: bytes) -> tuple[int, np.ndarray]:
    """Sampling rate and samples (samples by channels) of a WAV file, in units of full scale.

    Chunks may come in any order and be of odd length; a data chunk longer than the file ends with the file.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        part = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", part)
            if kind[0] == 0xFFFE and len(part) >= 26:
                kind = (int.from_bytes(part[24:26], "little"), *kind[1:])
        elif name == b"data":
            body = part
        at += 8 + size + size % 2
    if kind is None or body is None:
        raise ValueError("a WAV file needs a format and data")
    code, channels, rate, _, _, bits = kind
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels]
    if code == 3:
        x = np.frombuffer(body, f"<f{width}").astype(float)
    elif code == 1 and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif code == 1 and bits in (16, 24, 32):
        raw = np.zeros((len(body) // width, 4), np.uint8)
        raw[:, 4 - width :] = np.frombuffer(body, np.uint8).reshape(-1, width)
        x = raw.view("<i4").ravel() / 2.0**31
    else:
        raise ValueError(f"WAV of kind {code} with {bits} bits")
    return rate, x.reshape(-1, channels)


def encoded(x: np.ndarray, rate: int) -> bytes:
    """A WAV file of 16 bits of samples, one dimension or samples by channels; what is beyond full scale is cut."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    body = np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes()
    channels = x.shape[1]
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def read_wav(spark: SparkSession, path: str, channel: int = 0) -> DataFrame:
    """file, rate, length and x (samples of a channel) of the WAV files at a path, one file at a time in a task."""

    def each(batches):
        for b in batches:
            for file, content in zip(b["file"], b["content"]):
                rate, x = decoded(bytes(content))
                own = x[:, min(channel, x.shape[1] - 1)]
                yield pd.DataFrame({"file": [file], "rate": [rate], "length": [len(own)], "x": [own]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select(F.col("path").alias("file"), "content").mapInPandas(each, "file string, rate int, length long, x array<double>")


def wav_bytes(signals: DataFrame, rate: int, key: str = "sid") -> DataFrame:
    """key and data, the bytes of a WAV file, of each signal (key, x)."""

    def each(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "data": [encoded(np.asarray(x), rate) for x in b["x"]]})

    return signals.select(key, "x").mapInPandas(each, f"{key} long, data binary")
