"""Words and their hashes as flat numpy arrays, for use inside Arrow batches.

A batch of texts is cut into blocks of bounded size; a block keeps the UTF-8
bytes of its texts in one array and finds tokens and hashes without a Python
loop over words. A single text longer than the block size is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of 64-bit numbers."""
    x = np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(256, dtype=U64))
_powers = {"base": np.ones(1, U64), "inverse": np.ones(1, U64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base or its inverse modulo 2**64."""
    table = _powers[kind]
    if len(table) < n:
        steps = np.full(max(n, BLOCK_BYTES + (1 << 16)), _BASE if kind == "base" else _INVERSE, U64)
        steps[0] = 1
        table = _powers[kind] = np.multiply.accumulate(steps)
    return table[:n]


class Block:
    """Texts of some rows: ``data`` holds their bytes, ``bounds`` where each begins and ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self.rows = len(bounds) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes()

    def tokens(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes that are no separators: starts, ends and the row of each."""
        return self.runs(~separator[self.data])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of the bytes marked in ``inside``, cut where a text ends."""
        change = np.empty(len(inside) + 1, bool)
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        change[0], change[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
        edge = self.bounds[1:-1]
        edge = np.unique(edge[(edge > 0) & (edge < len(inside))])
        edge = edge[inside[edge] & inside[edge - 1]]  # two texts meet without a separator
        at = np.flatnonzero(change)
        if len(edge):
            at = np.sort(np.concatenate([at, edge, edge]))
        starts, ends = at[::2], at[1::2]
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1

    def prefix_sums(self, data: np.ndarray | None = None) -> np.ndarray:
        """Running polynomial sums of the bytes; see ``span_hash``."""
        data = self.data if data is None else data
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_VALUE[data] * _power_table("base", len(data)), out=out[1:])
        return out

    def words(self) -> Words:
        starts, ends, row = self.tokens(SPACE)
        return Words(self, starts, ends, row, span_hash(self.prefix_sums(), starts, ends))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end, equal for equal bytes."""
    inverse = _power_table("inverse", len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


class Words:
    """The words of a block: positions, row of each, hash of each, first word of each row."""

    def __init__(self, block, starts, ends, row, hashes):
        self.block, self.starts, self.ends, self.row, self.hashes = block, starts, ends, row, hashes
        self.first = np.searchsorted(row, np.arange(block.rows + 1))
        self.counts = np.diff(self.first)

    def windows(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``n`` words from each word on, and which of them lie in one row."""
        return windows(self.hashes, self.row, n, seed)


def windows(hashes: np.ndarray, row: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    factor, values = U64(_BASE), mix(hashes + U64(seed)) if seed else hashes
    out = values[:count].copy()
    for i in range(1, n):
        out *= factor
        out += values[i : i + count]
    return mix(out), row[:count] == row[n - 1 :]


def _as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row bounds within them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), bounds.astype(np.int64)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[slice, Block]]:
    """Cut a column of texts into blocks of about ``size`` bytes; a row is never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, bounds = _as_bytes(column)
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        end = min(end, at + 20_000, n)
        yield slice(at, end), Block(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end


def run_texts(block: Block, inside: np.ndarray, data: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The bytes of ``data`` at each run of ``inside`` as strings, and the row of each run."""
    starts, ends, row = block.runs(inside)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    texts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return texts, row


def distinct_codes(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different numbers below ``size`` in order, the place of each value among them, counts."""
    if size > 4 * len(values) + 1024:
        return np.unique(values, return_inverse=True, return_counts=True)
    counts = np.bincount(values, minlength=size)
    there = counts > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values], counts[there]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed numbers that a BIGINT column holds."""
    return x.view(np.int64)


@cache
def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters and the accented capitals of Latin-1, byte for byte."""
    out = lowered()[data]
    if len(out) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 0x20
    return out
