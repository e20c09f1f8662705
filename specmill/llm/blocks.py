"""Packed column blocks: many numbers in one row, so that a shuffle moves a few large rows."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*columns: np.ndarray, level: int = 1) -> bytes:
    """Columns as byte planes: planes that are all alike (high bytes) cost nothing after compression."""
    parts = [struct.pack("<B", len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c)
        parts += [struct.pack("<3sq", c.dtype.str[1:].encode().ljust(3), len(c)), c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    number, at, out = data[0], 1, []
    for _ in range(number):
        kind, n = struct.unpack_from("<3sq", data, at)
        at += 11
        dtype = np.dtype("<" + kind.decode().strip())
        size = n * dtype.itemsize
        out.append(np.frombuffer(data, np.uint8, size, at).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n))
        at += size
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def undeltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)
