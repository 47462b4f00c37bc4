"""Vectorised words, word hashes and shingles of Arrow text columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 that equals the pattern ``[^\\x20\\x09-\\x0D]+``.
Word hashes are 64-bit: a polynomial over a random byte table, mixed with the length. Everything works on slices of
whole texts of about SLICE bytes, so memory is bounded by the slice or by the longest single text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_OTHER = np.random.default_rng(20250111).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_P, _PINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_POW = {"p": np.ones(1, _U), "i": np.ones(1, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        m = (n | 0xFFFF) + 1
        for k, base in (("p", _P), ("i", _PINV)):
            x = np.full(m, _U(base), _U)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW["p"][:n], _POW["i"][:n]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at the end of a task the worker, which others use after it, gives free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Slice(NamedTuple):
    """Words of consecutive texts. Text i has the words ``first[i]`` to ``first[i + 1]``."""

    at: int  # index of the first text in its batch
    data: np.ndarray  # bytes of all texts
    text: np.ndarray  # where each text starts in data, and the end
    first: np.ndarray
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray
    total: np.ndarray  # running sums of the weighted bytes

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges from ``start`` to ``end``."""
        return _hash(self.total, start, end)

    def second(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges over another byte table: with :meth:`hash_of` they make 128 bits."""
        p, _ = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_OTHER[self.data] * p[: len(self.data)], out=total[1:])
        return _hash(total, start, end)


def slices(column: pa.Array, lower: bool = False, size: int = SLICE) -> Iterator[Slice]:
    """Slices of a string column; null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        data = raw[offs[i] : offs[j]]
        yield _cut(i, _LOWER[data] if lower else data, offs[i : j + 1] - offs[i])
        i = j


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(total))
    return mix(((total[end] - total[start]) * inv[start]) ^ ((end - start).astype(_U) * _U(0xD6E8FEB86659FD93)))


def _cut(at: int, data: np.ndarray, text: np.ndarray) -> Slice:
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return Slice(at, data, text, np.zeros(len(text), np.int64), e, e, np.zeros(0, _U), np.zeros(1, _U))
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[text] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    p, _ = _powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_TABLE[data] * p[:n], out=total[1:])
    return Slice(at, data, text, np.searchsorted(start, text), start, end, _hash(total, start, end), total)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    if k <= 8:
        out = np.zeros(n, _U)
        for i in range(k):
            out *= _U(0x2545F4914F6CDD1D)
            out += h[i : i + n]
    else:
        p, inv = _powers(len(h) + 1)
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(h * p[: len(h)], out=total[1:])
        out = (total[k:] - total[:-k]) * inv[:n]
    return mix(out ^ _U(k * 0x1D8E4E27C47D124F % 2**64))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; of its whole sequence if it has fewer words."""
    if not len(h):
        return np.zeros(0, _U)
    g = grams(h, min(k, len(h)))
    g.sort()
    keep = np.ones(len(g), bool)
    np.not_equal(g[1:], g[:-1], out=keep[1:])
    return g[keep]
