"""Data sources of Spark for files of sound and of recordings: spark.read.format("wav") and .format("recording").

Both list a folder once and deal its files out by size. A WAV file larger than a partition is shared by byte ranges: a task reads the
head of the file and the chunks of samples that begin in its range. Filters on file, channel and start are taken over by the
source, so files and ranges that cannot match are not opened, and columns that are not asked for are not decoded. Paths are those that pyarrow.fs opens;
read_wav of the module wav reads any that Spark opens, a file at a time.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

#: Bytes of files that a task reads, and samples of a row.
PART_BYTES, CHUNK = 32 << 20, 1 << 16


def opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Names below a folder (or of one file) with a suffix, and their sizes, by name; hidden ones and those of writers are left out."""
    from pyarrow import fs

    system, base = opened(path)
    base = base.rstrip("/")
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [("", info.size)]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    names = [(f.path[len(base) + 1 :], f.size) for f in found if f.type == fs.FileType.File]
    return sorted((n, s) for n, s in names if n.lower().endswith(suffix) and not any(p[0] in "._" for p in n.split("/")))


def joined(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}" if name else path


@dataclass
class Piece(ds.InputPartition):
    """Files, each with the byte range of it that belongs to the partition."""

    files: list[tuple[str, int, int, int]]


def pieces(files: list[tuple[str, int]], most: int, split: bool) -> list[Piece]:
    """Small files together up to a size; a larger one by ranges, or by itself."""
    out, held, size = [], [], 0
    for name, length in files:
        if length >= most:
            cuts = list(range(0, length, most)) if split else [0]
            out += [Piece([(name, length, a, b)]) for a, b in zip(cuts, [*cuts[1:], length + 1])]
            continue
        if held and size + length > most:
            out.append(Piece(held))
            held, size = [], 0
        held.append((name, length, 0, length + 1))
        size += length
    return [*out, Piece(held)] if held else out


@dataclass
class Wanted:
    """What pushed filters leave of a column."""

    among: set | None = None
    least: float = -np.inf
    most: float = np.inf

    def narrowed(self, values: set) -> None:
        self.among = values if self.among is None else self.among & values

    def has(self, value) -> bool:
        return (self.among is None or value in self.among) and (isinstance(value, str) or self.least <= value <= self.most)


def taken(filters: list, wanted: dict[str, Wanted]) -> Iterator:
    """Notes the filters that wanted can hold and yields the others."""
    for f in filters:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        own = wanted.get(name)
        number = isinstance(getattr(f, "value", None), (int, float)) and name != "file"
        if own is not None and isinstance(f, ds.EqualTo):
            own.narrowed({f.value})
        elif own is not None and isinstance(f, ds.In):
            own.narrowed(set(f.value))
        elif own is not None and isinstance(f, ds.IsNotNull):
            pass
        elif own is not None and number and isinstance(f, ds.GreaterThanOrEqual):
            own.least = max(own.least, f.value)
        elif own is not None and number and isinstance(f, ds.GreaterThan):
            own.least = max(own.least, f.value + 1)
        elif own is not None and number and isinstance(f, ds.LessThanOrEqual):
            own.most = min(own.most, f.value)
        elif own is not None and number and isinstance(f, ds.LessThan):
            own.most = min(own.most, f.value - 1)
        else:
            yield f


@dataclass
class Head:
    rate: int
    channels: int
    width: int
    floats: bool
    begin: int
    frames: int


def wav_head(f, size: int) -> Head:
    """Format and place of the samples of an open WAV file, by the heads of its chunks; the data end with the file at the latest."""
    first = f.read(12)
    if len(first) < 12 or first[:4] != b"RIFF" or first[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, data = 12, None, None
    while at + 8 <= size and (kind is None or data is None):
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            part = f.read(min(length, 40))
            kind = struct.unpack_from("<HHIIHH", part)
            if kind[0] == 0xFFFE and len(part) >= 26:
                kind = (int.from_bytes(part[24:26], "little"), *kind[1:])
        elif name == b"data":
            data = at + 8, max(0, min(length, size - at - 8))
        at += 8 + length + length % 2
    if kind is None or data is None:
        raise ValueError("a WAV file needs a format and data")
    code, channels, rate, _, _, bits = kind
    if (code, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)} or not channels:
        raise ValueError(f"WAV of kind {code} with {bits} bits")
    width = bits // 8
    return Head(rate, channels, width, code == 3, data[0], data[1] // (width * channels))


def samples(raw: bytes, head: Head) -> np.ndarray:
    """Samples (frames by channels) in units of full scale."""
    if head.floats:
        x = np.frombuffer(raw, f"<f{head.width}").astype(float)
    elif head.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        wide = np.zeros((len(raw) // head.width, 4), np.uint8)
        wide[:, 4 - head.width :] = np.frombuffer(raw, np.uint8).reshape(-1, head.width)
        x = wide.view("<i4").ravel() / 2.0**31
    return x.reshape(-1, head.channels)


class WavReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk, self.most = options["path"], int(options.get("chunk", CHUNK)), int(options.get("partbytes", PART_BYTES))
        self.wanted = {"file": Wanted(), "channel": Wanted(), "start": Wanted()}

    def pushFilters(self, filters: list) -> Iterator:
        return taken(filters, self.wanted)

    def partitions(self) -> list[Piece]:
        files = [x for x in listed(self.path, ".wav") if self.wanted["file"].has(x[0])]
        return pieces(files, self.most, True) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for name, size, a, b in partition.files:
            system, path = opened(joined(self.path, name))
            with system.open_input_file(path) as f:
                head = wav_head(f, size)
                frame = head.width * head.channels
                step = self.chunk * frame
                # chunks belong to the range in which they begin
                first, last = (max(0, -(-(x - head.begin) // step)) for x in (a, b))
                for c in range(first, min(last, -(-head.frames // self.chunk))):
                    start = c * self.chunk
                    channels = [k for k in range(head.channels) if self.wanted["channel"].has(k)]
                    if not channels or not self.wanted["start"].has(start):
                        continue
                    f.seek(head.begin + start * frame)
                    x = samples(f.read(min(self.chunk, head.frames - start) * frame), head)
                    n = len(channels)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array([head.rate] * n, pa.int32()), pa.array([head.frames] * n, pa.int64()), pa.array(channels, pa.int32()), pa.array([start] * n, pa.int64()), pa.array([x[:, k] for k in channels], pa.list_(pa.float64()))],
                        names=["file", "rate", "frames", "channel", "start", "x"],
                    )


class WavWriter(ds.DataSourceWriter):
    """Rows (file, rate, x) as files of 16 bits; a file that is there already is replaced."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        system, base = opened(self.path)
        if overwrite:
            from pyarrow import fs

            if system.get_file_info(base).type == fs.FileType.Directory:
                system.delete_dir_contents(base)
        system.create_dir(base, recursive=True)

    def write(self, iterator: Iterator) -> ds.WriterCommitMessage:
        from intervalia.sources.wav import encoded

        for row in iterator:
            system, path = opened(joined(self.path, row["file"]))
            # written beside and then moved, so that a task that is run again leaves whole files
            with system.open_output_stream(path + ".part") as f:
                f.write(encoded(np.asarray(row["x"], float), int(row["rate"])))
            system.move(path + ".part", path)
        return ds.WriterCommitMessage()


class WavSource(ds.DataSource):
    """file, rate, frames (of the file), channel, start (first sample of the row) and x (up to `chunk` samples).

    Options: path, chunk (samples of a row), partbytes (bytes of a task).
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "file string, rate int, frames long, channel int, start long, x array<double>"

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(dict(self.options), overwrite)


@dataclass
class Recording:
    """Names of the columns of a file and its values, row by row."""

    names: list[str]
    values: list[str] = field(default_factory=list)

    def rows(self) -> int:
        return -(-len(self.values) // len(self.names)) if self.names else 0


def recording(text: str) -> Recording:
    """A delimited text whose first line may name its columns: "% <a> <b>". Else they are Field1, Field2, ... by the first line.

    What follows a % in a line is a comment. Values are what blanks part, over the ends of lines.
    """
    lines = text.splitlines()
    if lines and lines[0].startswith("%"):
        names = re.findall(r"<(\w+)>", lines.pop(0))
    else:
        names = [f"Field{k + 1}" for k in range(len(lines[0].split("%")[0].split()))] if lines else []
    return Recording(names, [v for line in lines for v in line.split("%")[0].split()] if names else [])


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


class RecordingReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.most = options["path"], options.get("suffix", ".txt"), int(options.get("partbytes", PART_BYTES))
        self.wanted = {"file": Wanted(), "field": Wanted()}

    def pushFilters(self, filters: list) -> Iterator:
        return taken(filters, self.wanted)

    def partitions(self) -> list[Piece]:
        files = [x for x in listed(self.path, self.suffix) if self.wanted["file"].has(x[0])]
        return pieces(files, self.most, False) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for name, *_ in partition.files:
            system, path = opened(joined(self.path, name))
            with system.open_input_stream(path) as f:
                found = recording(f.read().decode("utf-8", "replace"))
            for k, column in enumerate(found.names):
                if self.wanted["field"].has(column):
                    values = found.values[k :: len(found.names)]
                    numbers = [number(v) for v in values]
                    # a column is of numbers if every value is one
                    numbers = [None] * len(values) if None in numbers else numbers
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(range(len(values)), pa.int64()), pa.array([column] * len(values), pa.string()), pa.array(values, pa.string()), pa.array(numbers, pa.float64())], names=["file", "row", "field", "text", "number"])


class RecordingSource(ds.DataSource):
    """file, row, field, text and number (null unless the whole column is of numbers) of delimited texts; options: path, suffix (.txt)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return "file string, row long, field string, text string, number double"

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets them take over filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WavSource, RecordingSource):
        spark.dataSource.register(source)
