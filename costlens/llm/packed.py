"""Arrays of numbers as compact binary values: the bytes of the smallest fitting type, by
significance, compressed. Spark moves such a value as a whole instead of number by number.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<BQ")
_KINDS = [np.uint8, np.uint16, np.uint32, np.uint64]


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, of less than 64 bits."""
    top = int(values.max(initial=0))
    kind = next(k for k in _KINDS if top <= np.iinfo(k).max)
    width = np.dtype(kind).itemsize
    raw = np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(-1, width).T.tobytes()
    return _HEAD.pack(width, len(values)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(value: pa.BinaryScalar) -> np.ndarray:
    buffer = value.as_buffer()
    width, count = _HEAD.unpack(buffer.slice(0, _HEAD.size).to_pybytes())
    raw = pa.decompress(buffer.slice(_HEAD.size), decompressed_size=width * count, codec="zstd")
    by_rank = np.frombuffer(raw, np.uint8).reshape(width, count)
    kind = {np.dtype(k).itemsize: k for k in _KINDS}[width]
    return np.ascontiguousarray(by_rank.T).view(kind).reshape(-1).astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers from 0 on, as the steps between them."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(value: pa.BinaryScalar) -> np.ndarray:
    return np.cumsum(unpack(value))
