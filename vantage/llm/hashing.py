"""Vectorised hashes of byte windows and of words, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_R, _SEED = np.uint64(0x9E3779B97F4A7C15), 20240607
TABLE = np.random.default_rng(_SEED).integers(1, 2**64 - 1, 256, dtype=np.uint64)
#: Longest stretch of bytes that is hashed at once.
CHUNK = 1 << 22
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((int(_R), pow(int(_R), -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(31))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash takes the hash of any range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(len(data))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary or string column without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets, data
