"""Vectorised word spans and hashes over Arrow string columns.

Texts are handled as UTF-8 bytes in numpy, a few MB at a time, so memory is bounded
by the longest single text. Null texts count as empty. Word classes:

SPACED  runs without the bytes 0x20 and 0x09-0x0D
ALNUM   runs of 0-9, A-Z, a-z and bytes from 0x80
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_a : _b + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x632BE59BD9B4E019))
_POWERS = np.zeros(0, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n-1, modulo 2 to the 64."""
    global _POWERS
    if n > len(_POWERS):
        p = np.full(max(n, 64, 2 * len(_POWERS)), BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


class Texts:
    """Some rows' texts as one byte buffer; row i holds bytes offsets[i] to offsets[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def words(self, kind: np.ndarray) -> Words:
        n = len(self.data)
        inside = kind[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty(n, bool)
        after[-1:], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return Words(self, starts, ends)


class Words:
    """Word spans in byte positions; words of row i are rows[i] to rows[i+1]."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.rows = np.searchsorted(starts, texts.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word byte's share in its word's hash, and where each word begins in that."""
        length = self.ends - self.starts
        first = np.cumsum(length) - length
        at = np.arange(int(length.sum())) - np.repeat(first, length)
        data = self.texts.data[at + np.repeat(self.starts, length)]
        return _BYTE[data] * powers(int(length.max(initial=1)))[at], first

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        parts, first = self.parts()
        return mix(np.add.reduceat(parts, first))

    def windows(self, hashes: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each k consecutive words of a row, and the index of its first word."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        p = mix(np.arange(1, k + 1, dtype=np.uint64) + _U(salt * 1_000_003)) | _U(1)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * p[j]
        at = np.arange(n)
        end = np.repeat(self.rows[1:], self.counts())[:n]
        ok = at + k <= end
        return mix(total[ok]), at[ok]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) for runs of rows of about `most` bytes, or one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker hands freed memory back when a task ends: workers outlive tasks and idle beside later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return wrapped
