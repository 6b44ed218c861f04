"""Words of Arrow text batches as numpy arrays: positions and 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which is [^\\x20\\x09-\\x0D]+ on UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are worked on at once; the arrays of a piece take some fifty times as much.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. modulo 2^64, at least n of each."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


@dataclass
class Words:
    """Words of some documents in a row. offsets[i]:offsets[i+1] are those of document i of this piece."""

    first: int  # row of the piece's first document in its batch
    data: np.ndarray  # bytes of the piece
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def doc(self) -> np.ndarray:
        """Each word's document in the piece."""
        return np.repeat(np.arange(self.docs), np.diff(self.offsets))


class Spans:
    """Hashes of word spans from one prefix sum."""

    def __init__(self, h: np.ndarray, base: int = _STEP):
        p, self.inverse = _powers(base, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * p[: len(h)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count and np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():
        return text_buffers(pc.fill_null(column, ""))
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving Arrow's unused memory back at the end of a task: a Python worker lives on for the tasks of later stages."""

    def leaned(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return leaned


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole documents of about CHUNK bytes."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def byte_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte, to be summed by Spans."""
    return _BYTE[data]


def words(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(first, data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    ink = ~space[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = ink[edge]
    ends[edge - 1] = ink[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    p, inverse = _powers(_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * p[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(first, data, start, end, h, np.searchsorted(start, offsets))


def batch_words(column: pa.Array, lower: bool = False, space: np.ndarray = _SPACE) -> Iterator[Words]:
    for piece in pieces(column):
        yield words(*piece, lower=lower, space=space)
