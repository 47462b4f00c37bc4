"""Texts cut where every tokenizer used here cuts too, so that each distinct piece is encoded once and looked up after.

All patterns in use end a token before white space and between Latin letters and ASCII marks (but the apostrophe of
contractions), and join one space to what follows. So a piece goes from the end of a word to the end of the next one,
with the white space before it; words of Latin letters and such marks alone are also cut between the two. Encoding piece
by piece then equals encoding the text. Texts with white space beyond ASCII are one piece.

Pieces are found, hashed to 128 bits and told apart for a slice of texts at once; only those not seen before become
objects. What a worker remembers are sorted arrays of hashes and the ids, without an object for a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from quillgraph.llm.words import Slice, slices

#: Bytes of text that are worked on at once, and pieces that a worker remembers.
SLICE, REMEMBERED = 1 << 20, 600_000
#: White space beyond ASCII.
_ODD = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACES
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; the letters of Latin-1 are two bytes, 0xC3 and another."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def pieces(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where pieces end in the slice's bytes, where they start, the number of pieces before each text)."""
    n = len(s.data)
    kind = _classes(s.data)
    ends = np.zeros(n + 1, bool)
    ends[s.end] = ends[s.text[1:]] = True
    ends[0] = False
    # Between letters and marks of words that have nothing else.
    between = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] % 3 != 0) & (kind[:-1] % 3 != 0)) + 1
    word = np.searchsorted(s.start, between, "right") - 1
    others = np.concatenate(([0], np.cumsum(kind == _OTHER)))
    ends[between[others[s.end[word]] == others[s.start[word]]]] = True
    end = np.flatnonzero(ends)
    return end, np.concatenate(([0], end[:-1])), np.searchsorted(end, s.text, "right")


def whole_rows(rows: list[bytes]) -> Slice:
    """A slice of ``rows``, of which only the hashes of whole rows are of use."""
    return next(slices(pa.array(rows, pa.large_binary()), size=1 << 62), None) or next(slices(pa.array([b""], pa.large_binary())))


def distinct(s: Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of its distinct piece for each piece, first piece of each, both hashes of each)."""
    h, other = s.hash_of(start, end), s.second(start, end)
    code, _ = pd.factorize(h)
    first = np.zeros(code.max(initial=-1) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    if (other != other[first[code]]).any():  # two pieces share the first hash
        code = pd.MultiIndex.from_arrays([h, other]).factorize()[0]
        first = np.zeros(code.max(initial=-1) + 1, np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, first, h[first], other[first]


class SegmentEncoder:
    """Little-endian 32-bit ids of texts. ``encode`` gets distinct unseen pieces and gives their ids as bytes.

    Texts for which ``whole`` is true are one piece. ``given`` has the ids of pieces by their hashes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[pa.Array], pa.Array] | None = None, given: Given | None = None, remembered: int = REMEMBERED):
        self.encode, self.whole, self.given, self.remembered = encode, whole, given, remembered
        self.forget()

    def forget(self) -> None:
        """Give the memory of the pieces back."""
        self.n = 0
        self.h, self.nth = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and the numbers of their pieces
        self.other = np.zeros(1 << 16, np.uint64)
        self.flat, self.start = np.zeros(1 << 16, "<i4"), np.zeros(1 << 16, np.int64)  # ids of piece i: start[i] to start[i + 1]

    def _find(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        if not self.n:
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        nth = self.nth[at]
        return np.where((self.h[at] == h) & (self.other[nth] == other), nth, -1)

    def _add(self, new: list[bytes], h: np.ndarray, other: np.ndarray) -> None:
        ids = self.encode([w.decode() for w in new])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at, n = self.n, int(size.sum())
        used = int(self.start[at])
        while at + len(ids) + 1 > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.other = np.concatenate((self.other, np.zeros_like(self.other)))
        while used + n > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.start[at + 1 : at + len(ids) + 1] = used + np.cumsum(size)
        self.flat[used : used + n] = np.frombuffer(b"".join(ids), "<i4")
        self.other[at : at + len(ids)] = other
        self.n += len(ids)
        order = np.argsort(h)
        place = np.searchsorted(self.h, h[order])
        self.h, self.nth = np.insert(self.h, place, h[order]), np.insert(self.nth, place, at + order)

    def _slice(self, s: Slice) -> list[bytes]:
        if not len(s.data):
            return [b""] * (len(s.text) - 1)
        end, start, first_of = pieces(s)
        code, first, h, other = distinct(s, start, end)
        begin, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        own = np.arange(len(first))
        given = 0
        if self.given is not None:
            begin, size, hit = self.given.find(h, other)
            own, given = own[~hit], len(self.given.flat)
        if self.n > self.remembered:
            self.forget()
        index = self._find(h[own], other[own])
        missing = np.flatnonzero(index < 0)
        if len(missing):
            raw, new = s.data.tobytes(), own[missing]
            index[missing] = np.arange(self.n, self.n + len(missing))
            self._add([raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())], h[new], other[new])
        begin[own], size[own] = given + self.start[index], self.start[index + 1] - self.start[index]
        used = int(self.start[self.n])
        flat = self.flat[:used] if self.given is None else np.concatenate((self.given.flat, self.flat[:used]))
        n = size[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[code] - ends + n, n) + np.arange(ends[-1])].tobytes()
        at = (np.concatenate(([0], ends))[first_of] * 4).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def texts(self, texts: list[str]) -> list[bytes]:
        return [x for _, rows in self.column(pa.array(texts, pa.string())) for x in rows]

    def column(self, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(index of the first text, ids of each) for slices of a string column; null is the empty text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(column, _ODD)
        if self.whole:
            whole = pc.or_(whole, self.whole(column))
        whole = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        apart = {int(i): self.encode([column[int(i)].as_py()])[0] for i in whole}
        if apart:
            keep = np.ones(len(column), bool)
            keep[whole] = False
            column = pc.if_else(pa.array(keep), column, "")
        for s in slices(column, size=SLICE):
            rows = self._slice(s)
            for i in apart.keys() & range(s.at, s.at + len(rows)):
                rows[i - s.at] = apart[i]
            yield s.at, rows


class Given:
    """Ids of pieces by both their hashes: sorted arrays, so that a worker holds no objects for them."""

    def __init__(self, h: np.ndarray, other: np.ndarray, size: np.ndarray, flat: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.h, self.other, self.size = h[order], other[order], size[order]
        self.start, self.flat = (np.cumsum(size) - size)[order], flat

    def find(self, h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where the ids start, how many, whether the piece is known)."""
        if not len(self.h):
            none = np.zeros(len(h), np.int64)
            return none, none.copy(), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return self.start[i], self.size[i], (self.h[i] == h) & (self.other[i] == other)
