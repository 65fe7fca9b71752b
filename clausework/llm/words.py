"""Vectorised word and line tables over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; all of these are ASCII, so working on UTF-8 bytes is
exact. Hashes are 64-bit polynomials over the bytes, mixed by a finaliser; two different words collide with odds of about
2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    buf: np.ndarray  # uint8, bytes of all texts of the chunk
    docs: np.ndarray  # int64, n+1 offsets of the texts
    start: np.ndarray  # byte offsets of words
    end: np.ndarray
    prefix: np.ndarray  # uint64 prefix sums for hashes, one longer than buf

    @property
    def bounds(self) -> np.ndarray:
        """n+1 offsets of the texts in the word table."""
        return np.searchsorted(self.start, self.docs)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _pow(len(self.prefix))[1]
        return mix((self.prefix[end] - self.prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each; a longer text stands alone."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, len(lengths)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a large_string array without nulls."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(column: pa.Array) -> Words:
    """Word table of a large_string array without nulls."""
    buf, docs = raw(column)
    n = len(buf)
    ink = ~_SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[docs] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | first[:n]))
    after = np.empty(n, bool)
    after[n - 1 :] = False
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | first[1:])) + 1
    power = _pow(n + 1)[0]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    return Words(buf, docs, start, end, prefix)


def batches(frames: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches of about ``most`` bytes of text, each with its text column."""
    for batch in frames:
        column = text_column(batch.column(text))
        for a, b in chunks(column, most):
            yield batch.slice(a, b - a), column.slice(a, b - a)
