"""Integer arrays in compressed byte planes, 64-bit mixing and dealing by bucket, for tasks that send blocks instead of rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, as compressed byte planes."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    n = len(arrays[0])
    parts = [z.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T).tobytes()) if n else b"" for a in arrays]
    return struct.pack(f"<I{len(parts)}I", n, *map(len, parts)) + b"".join(parts)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    n, *sizes = struct.unpack_from(f"<I{len(kinds)}I", data)
    at, out = 4 + 4 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        raw = np.frombuffer(d.decompress(data[at : at + size]), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += size
    return out


def by_bucket(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b] : cuts[b + 1]]
        yield b, [x[at] for x in arrays]
