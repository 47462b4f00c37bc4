"""Auto-links: a similarity self-join of bags of words above a threshold.

Common words pair most rows at low thresholds, so joining on words would write out nearly all pairs. Rows are packed into
tiles of bounded size instead, each written once, and every pair of tiles is compared where it is read: a Cartesian product
of the tiles shuffles nothing, so disk grows with the rows and not with the pairs of blocks. Work at low thresholds is
quadratic by nature; memory is that of a few tiles.

Within a pair of tiles common words are columns of a matrix product and the others posting lists. Where the posting lists
leave few pairs that can still reach the threshold, as at high ones, only those are counted in full. Rows are dealt into
tiles by their number of words: a pair of tiles whose sizes differ too much has no links and is not read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import hashed_words
from quillgraph.plans.durable import durable

#: Rows and words that a tile holds at most (a single row may hold more words), rows of it compared at a time, words that
#: have a column of their own at most, numbers of columns, candidates confirmed at a time, bytes of flags for it,
#: and words looked up in them from which they are for fewer rows.
TILE, TILE_WORDS, SLICE, COMMON, COLUMNS, HELD, FLAGS, WORK = 4096, 1_500_000, 1024, 4096, (512, 1024, 2048, 4096, 8192), 200_000, 1_500_000, 20_000
#: The number of columns is first such that words that meet by chance in one are this share of what a link needs. Then fewer
#: and more are tried on a row of PROBE on either side. Nanoseconds of a column for a pair of rows, and of
#: confirming a candidate and for each of its words; they decide how fast links are found, not which.
CHANCE, PROBE, PER_COLUMN, PER_CANDIDATE, PER_WORD = 0.12, (16, 8), 0.0023, 300, 3
#: Groups of rows at most, rows and common words that they are learned from, and likeness from which two are one. Groups,
#: as of languages, decide which rows share tiles and so how fast tiles are compared, not which links are found.
GROUPS, LEARN, LEADING, ALIKE = 8, 4096, 1024, 0.5
#: Pairs of rows up to which words are compared pair by pair.
SINGLE = 60
#: Tiles that a task keeps unpacked, and bytes of their columns.
KEPT, KEPT_BYTES = 6, 64_000_000
#: Texts of which words are made at a time.
TEXTS = 512
#: Rows from which the common words are chosen. The choice decides how fast pairs are counted, not which are found.
SAMPLE = 20_000
#: Links that are held at a time to find out what they connect.
FOREST = 2_000_000
ROUND = 1e-9
LINKS = "source_seq long, target_seq long, weight double"
_TILE = "tile long, least int, most int, seqs binary, sizes binary, owns binary, common binary, words binary, rest binary"


def _bags(nodes: DataFrame, of: Callable | None = None, more: str = "") -> DataFrame:
    """(seq, bag) with 64-bit hashes for words, or what ``of`` makes of a batch of those, with columns ``more``.

    Empty bags are left in. Few texts are taken at a time, so their words take little memory; nothing else runs in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                flat, counts = hashed_words(part.column(1).to_pylist())
                bags = pa.ListArray.from_arrays(pa.array(_ends(counts).astype(np.int32)), pa.array(flat))
                found = pa.RecordBatch.from_arrays([part.column(0), bags], ["seq", "bag"])
                yield of(found) if of else found

    lowered = nodes.select("seq", F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    return lowered.mapInArrow(run, f"seq long, {more}" if of else "seq long, bag array<long>")


def _common(nodes: DataFrame, rows: int) -> np.ndarray:
    """Hashes of frequent words, the most frequent first."""
    some = nodes if rows <= SAMPLE else nodes.where(F.pmod(F.xxhash64("seq"), F.lit(math.ceil(rows / SAMPLE))) == 0)
    found = _bags(some).select(F.explode("bag").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(COMMON)
    return np.array([x["w"] for x in found.collect()], np.int64)


def _ranks(common: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Which of some words are common, and the ranks of those."""
    order = np.argsort(common, kind="stable")
    ordered = common[order]

    def run(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(ordered, words), max(0, len(common) - 1))
        hit = ordered[at] == words if len(common) else np.zeros(len(words), bool)
        return hit, order[at[hit]]

    return run


def _leading(bags: pa.Array, ranks: Callable) -> np.ndarray:
    """A row for each bag, a column for each of the leading words: 1 if it is there."""
    hit, rank = ranks(bags.flatten().to_numpy())
    out = np.zeros((len(bags), LEADING), np.float32)
    out[np.repeat(np.arange(len(bags)), bags.value_lengths().to_numpy())[hit], rank] = 1
    return out


def _centres(nodes: DataFrame, rows: int, common: np.ndarray) -> np.ndarray:
    """What the rows of each group have of the leading words."""
    some = nodes if rows <= LEARN else nodes.where(F.pmod(F.xxhash64("seq", F.lit(1)), F.lit(math.ceil(rows / LEARN))) == 0)
    ranks = _ranks(common[:LEADING])

    def lead(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.packbits(_leading(batch.column(1), ranks) > 0, axis=1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary())], ["seq", "bits"])

    found = sorted((x[0], bytes(x[1])) for x in _bags(some, lead, "bits binary").collect())
    seen = np.unpackbits(np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, LEADING // 8), axis=1).astype(np.float32)
    seen = seen[seen.any(1)]
    if not len(seen):
        return np.zeros((1, LEADING), np.float32)
    unit = lambda a: a / np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-9)
    seen = unit(seen)
    centres = seen[:1]
    # The rows with the most words are the surest: the next centre is the one of them that is least like the others.
    sure = seen[np.argsort((seen > 0).sum(1), kind="stable")[-max(1, len(seen) // 2) :]]
    while len(centres) < min(GROUPS, len(sure)):
        centres = np.concatenate((centres, sure[[np.argmin((sure @ centres.T).max(1))]]))
    for _ in range(8):
        best = (seen @ centres.T).argmax(1)
        centres = unit(np.stack([seen[best == k].sum(0) if (best == k).any() else centres[k] for k in range(len(centres))]))
    n = np.bincount((seen @ centres.T).argmax(1), minlength=len(centres))
    name = np.arange(len(centres))
    for i, j in zip(*np.nonzero(np.triu(centres @ centres.T >= ALIKE, 1))):
        name[name == name[j]] = name[i]
    return unit(np.stack([(centres * n[:, None])[name == k].sum(0) for k in np.unique(name)])).astype(np.float32)


def _grouped(common: np.ndarray, centres: np.ndarray) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """(seq, bag, kind): the group that each row is the most like."""
    ranks = _ranks(common[:LEADING])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = (_leading(batch.column(1), ranks) @ centres.T).argmax(1).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds)], ["seq", "bag", "kind"])

    return run


def _pack(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles of rows (seq, bag): the ranks of a row's common words, and its others as places in the tile's list of words."""
    ranks = _ranks(common)

    def tile(k: int, seqs: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(seqs)), sizes)
        hit, rank = ranks(words)
        some, rest = np.unique(words[~hit], return_inverse=True)
        owns = np.bincount(row[hit], minlength=len(seqs))
        blobs = (seqs, sizes.astype(np.int32), owns.astype(np.int32), rank.astype(np.uint16), some, rest.astype(np.int32))
        head = (pa.array([k], pa.int64()), pa.array([sizes.min()], pa.int32()), pa.array([sizes.max()], pa.int32()))
        return pa.RecordBatch.from_arrays([*head, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["tile", "least", "most", "seqs", "sizes", "owns", "common", "words", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        seqs, sizes, words, n, w, last = [], [], [], 0, 0, None
        for batch in batches:
            kind = batch.column(2).to_numpy()[batch.column(1).value_lengths().to_numpy() > 0] if batch.num_columns > 2 else np.zeros(0)
            turns = np.append(np.flatnonzero(np.diff(kind)) + 1, 1 << 60)
            length, flat = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten().to_numpy()
            ids, length = batch.column(0).to_numpy()[length > 0], length[length > 0]
            ends, done = np.cumsum(length), 0
            if n >= TILE // 8 and len(kind) and kind[0] != last:
                yield tile(k, *map(np.concatenate, (seqs, sizes, words)))
                k += 1
                seqs, sizes, words, n, w = [], [], [], 0, 0
            last = kind[-1] if len(kind) else last
            while done < len(ids):
                base = ends[done - 1] if done else 0
                upto = min(done + TILE - n, int(np.searchsorted(ends, base + TILE_WORDS - w, "right")))
                if upto <= done and not n:
                    upto = done + 1
                turn = int(turns[np.searchsorted(turns, max(done + 1, done + TILE // 8 - n))])
                upto = min(upto, turn)  # a tile of TILE // 8 rows ends with its group
                if upto > done:
                    seqs.append(ids[done:upto])
                    sizes.append(length[done:upto])
                    words.append(flat[base : ends[upto - 1]])
                    n, w, done = n + upto - done, w + len(words[-1]), upto
                if done < len(ids):
                    yield tile(k, *map(np.concatenate, (seqs, sizes, words)))
                    k += 1
                    seqs, sizes, words, n, w = [], [], [], 0, 0
        if n:
            yield tile(k, *map(np.concatenate, (seqs, sizes, words)))

    return run


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def _spread(begin: np.ndarray, end: np.ndarray, of: np.ndarray, plus: np.ndarray | None = None) -> np.ndarray:
    """of[begin:end] of each range, one after the other, with what ``plus`` has for the range."""
    n = end - begin
    at = np.repeat((begin - _ends(n)[:-1]).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    out = np.repeat(plus.astype(np.int32), n) if plus is not None else np.zeros(len(at), np.int32)
    out += of[at]
    return out


#: Columns of tiles by :meth:`_Tile.columns`, the last used last.
_kept: dict[tuple, np.ndarray] = {}
_numbers = itertools.count()


class _Tile:
    def __init__(self, blobs: list) -> None:
        of = lambda b, kind: np.frombuffer(b.as_buffer(), kind)
        self.seqs, self.sizes, self.owns = of(blobs[0], np.int64), of(blobs[1], np.int32), of(blobs[2], np.int32)
        self.common, self.words, self.rest = of(blobs[3], np.uint16), of(blobs[4], np.int64), of(blobs[5], np.int32)
        self.own_begin, self.rest_begin = _ends(self.owns), _ends(self.sizes - self.owns)
        self.slices = [(a, min(a + SLICE, len(self.seqs))) for a in range(0, len(self.seqs), SLICE)]
        self.root = np.sqrt(self.sizes.astype(np.float64))
        self.number = next(_numbers)
        self._hashes: dict = {}
        self._full: dict = {}

    @functools.cached_property
    def bits(self) -> np.ndarray:
        """Common words of each row, 64 to a number."""
        return self._bits(self.owns, self.common)

    @functools.cached_property
    def rest_bits(self) -> np.ndarray:
        """The others, by COMMON places that they are dealt to."""
        return self._bits(self.sizes - self.owns, (self.words & (COMMON - 1)).astype(np.int32)[self.rest])

    @functools.cached_property
    def surplus(self) -> np.ndarray:
        """Words of each row beyond one a place."""
        return self.sizes - self.owns - np.bitwise_count(self.rest_bits).sum(1, dtype=np.int64)

    def rest_of(self, k: int) -> np.ndarray:
        return self.words[self.rest[self.rest_begin[k] : self.rest_begin[k + 1]]]

    def _bits(self, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
        out, begin = [], _ends(counts)
        for a, b in self.slices:
            bits = np.zeros((b - a) * COMMON, bool)
            bits[np.repeat(np.arange(b - a) * COMMON, counts[a:b]) + places[begin[a] : begin[b]]] = True
            out.append(np.packbits(bits))
        return np.concatenate(out).view(np.uint64).reshape(len(self.seqs), -1)

    def _hash(self, first: int, n: int) -> np.ndarray:
        if n not in self._hashes:
            self._hashes[n] = (first + (self.words & 0x7FFFFFFF) % n).astype(np.int32)
        return self._hashes[n]

    def full(self, k: int, n: int) -> np.ndarray:
        """Rows of :meth:`columns` that may have more words in a column than it says."""
        if (k, n) not in self._full:
            a, b = self.slices[k]
            self._full[k, n] = np.flatnonzero(self.columns(k, n, False).max(1) == 255) if self.sizes[a:b].max() >= 255 else np.empty(0, int)
        return self._full[k, n]

    def columns(self, k: int, n: int, across: bool, step: int = 1) -> np.ndarray:
        """Words of slice ``k``, or of one in ``step`` of its rows, in each of ``n`` columns: up to half of them are one common
        word each, the others many words. Rows are numbers of words, or ``across`` columns that say if there is one."""
        key = (self.number, k, n, across, step)
        if key in _kept:
            _kept[key] = _kept.pop(key)
            return _kept[key]
        rows, half = np.arange(*self.slices[k], step), min(n // 2, COMMON)
        own, rest = (_spread(begin[rows], begin[rows + 1], of) for begin, of in ((self.own_begin, self.common), (self.rest_begin, self.rest)))
        if n not in self._hashes:
            self._hashes[n] = (half + (self.words & 0x7FFFFFFF) % (n - half)).astype(np.int32)
        own, rest = np.where(own < half, own, half + own % np.int32(n - half)), self._hashes[n][rest]
        most = self.sizes[rows].max()
        kind = np.int8 if across else np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int32
        out = np.zeros(n * len(rows), kind)
        for column, count in ((own, self.owns[rows]), (rest, (self.sizes - self.owns)[rows])):
            row = np.repeat(np.arange(len(rows)), count)
            if across:
                out[column * np.int64(len(rows)) + row] = 1
            else:
                np.add.at(out, row * n + column, kind(1))
        _kept[key] = out.reshape(n, -1) if across else np.minimum(out, kind(255), out=out).astype(np.uint8, copy=False).reshape(-1, n)
        while len(_kept) > 2 and sum(x.nbytes for x in _kept.values()) > KEPT_BYTES:
            del _kept[next(iter(_kept))]
        return _kept[key]

    def full(self, k: int, n: int, step: int) -> np.ndarray:
        """Rows of :meth:`columns` that may have more words in a column than it says."""
        a, b = self.slices[k]
        if self.sizes[a:b].max() < 255:
            return np.empty(0, int)
        key = (k, n, step)
        if key not in self._full:
            self._full[key] = np.flatnonzero(self.columns(k, n, False, step).max(1) == 255)
        return self._full[key]


@functools.cache
def _product() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A product of matrices of unsigned and signed bytes: ONNX Runtime's if it is there, which is many times as fast."""
    try:
        import onnxruntime
    except ImportError:
        return lambda a, b: a.astype(np.float32) @ b.astype(np.float32)
    part = lambda field, b: bytes([field << 3 | 2, len(b)]) + b
    number = lambda field, n: bytes([field << 3, n])
    side = lambda name, kind: part(1, name) + part(2, part(1, number(1, kind) + part(2, part(1, part(2, name + b"0")) + part(1, part(2, name + b"1")))))
    node = part(1, b"a") + part(1, b"b") + part(2, b"c") + part(4, b"MatMulInteger")
    graph = part(1, node) + part(2, b"g") + part(11, side(b"a", 2)) + part(11, side(b"b", 3)) + part(12, side(b"c", 6))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.enable_cpu_mem_arena = False
    options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_DISABLE_ALL
    session = onnxruntime.InferenceSession(number(1, 8) + part(7, graph) + part(8, number(2, 13)), options, providers=["CPUExecutionProvider"])
    return lambda a, b: session.run(None, {"a": a, "b": b})[0]


def _wide(x: float, y: float, threshold: float) -> int:
    """Which of COLUMNS rows of ``x`` and ``y`` words begin with, ``x`` the fewer."""
    for level, n in enumerate(COLUMNS):
        if x / 2 * (1 - math.exp(-y / n)) <= CHANCE * threshold * math.sqrt(x * y):
            return level
    return len(COLUMNS) - 1


def _candidates(x: _Tile, y: _Tile, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two tiles that may be linked, and all that are.

    Shared words of a column are at most the words that one row has in it, if the other has any."""
    moved = 0
    for i, (a, b) in enumerate(x.slices):
        for j, (c, d) in enumerate(y.slices):
            if same and j < i:
                continue
            (u, e, f, g), (v, k, m, l) = one, two = (x, i, a, b), (y, j, c, d)  # noqa: E741
            if min(x.sizes[a:b].max(), y.sizes[c:d].max()) < (threshold * threshold - ROUND) * max(x.sizes[a:b].min(), y.sizes[c:d].min()):
                continue
            turned = x.sizes[a:b].mean() > y.sizes[c:d].mean()
            if turned:
                (u, e, f, g), (v, k, m, l) = two, one  # noqa: E741
            need, other = threshold * (1 - 1e-5) * u.root[f:g], v.root[m:l]

            def found(n: int, step: int = 1, by: int = 1) -> tuple[np.ndarray, np.ndarray]:
                least, root = need[::step].copy(), other[::by]
                least[u.full(e, n, step)] = 0
                most = _product()(u.columns(e, n, False, step), v.columns(k, n, True, by))
                at = np.flatnonzero(most >= np.ceil(least * root.min()).astype(most.dtype)[:, None])
                p, q = np.divmod(at.astype(np.int32), np.int32(len(root)))
                good = most.ravel()[at] >= least[p] * root[q]
                return p[good], q[good]

            each = (PER_CANDIDATE + PER_WORD * u.sizes[f:g].mean()) / (len(need[:: PROBE[0]]) * len(other[:: PROBE[1]]))
            cost = functools.cache(lambda at: PER_COLUMN * COLUMNS[at] + each * len(found(COLUMNS[at], *PROBE)[0]))
            level = max(0, min(len(COLUMNS) - 1, _wide(u.sizes[f:g].mean(), v.sizes[m:l].mean(), threshold) + moved))
            first = level
            while level and cost(level - 1) <= cost(level):
                level -= 1
            while level < len(COLUMNS) - 1 and cost(level) > PER_COLUMN * COLUMNS[level + 1] and cost(level + 1) < cost(level):
                level += 1
            moved += level - first
            p, q = found(COLUMNS[level])
            for c in range(0, len(p), HELD):
                some, others = f + p[c : c + HELD], m + q[c : c + HELD]
                yield (others, some) if turned else (some, others)


def _and(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    both = np.zeros(len(p), np.int64)
    for k in range(0, len(p), 1024):
        both[k : k + 1024] = np.bitwise_count(x[p[k : k + 1024]] & y[q[k : k + 1024]]).sum(1, dtype=np.uint16)
    return both


def _shared(x: _Tile, y: _Tile, threshold: float, exact: bool, p: np.ndarray, q: np.ndarray, places: dict) -> np.ndarray:
    """Numbers of words that rows p of ``x`` and q of ``y`` share, where they may be linked; if not ``exact``, enough of them."""
    both = _and(x.bits, y.bits, p, q)
    need = threshold * (1 - 1e-5) * x.root[p] * y.root[q]
    may = np.arange(len(p)) if exact else np.flatnonzero(both < threshold * (1 + 1e-5) * x.root[p] * y.root[q])
    more = _and(x.rest_bits, y.rest_bits, p[may], q[may])
    more = np.where(more > 0, more + np.minimum(x.surplus[p[may]], y.surplus[q[may]]), 0)
    may = may[(more > 0) & (both[may] + more >= need[may])]
    if len(may):
        p, q = p[may], q[may]
        if len(may) <= SINGLE:
            both[may] += [len(np.intersect1d(x.rest_of(i), y.rest_of(j), True)) for i, j in zip(p, q)]
            return both
        fewer = x.sizes[p].sum() <= y.sizes[q].sum()
        if fewer not in places:
            places[fewer] = _places(*((x, y) if fewer else (y, x)))
        both[may] += _rest(x, y, places[fewer], p, q) if fewer else _rest(y, x, places[fewer], q, p)
    return both


def _rest(x: _Tile, y: _Tile, place: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words but common ones rows p of ``x`` and q of ``y`` share; ``place``: where the words of ``x`` are among those of ``y``."""
    both = np.zeros(len(p), np.int64)
    word = place[x.rest]
    known = word >= 0
    begin = _ends(known)[x.rest_begin]
    word, length = word[known].astype(np.int32), np.diff(begin)
    order = np.argsort(q, kind="stable")
    v, rows = len(y.words), np.unique(q)
    if not v:
        return both
    # The more words there are to look up for a row, the fewer rows have flags at a time: those stay in the cache.
    each = length[p].sum() / len(rows)
    flag = np.zeros(min(len(rows), max(1, FLAGS // v), math.ceil(WORK / max(1, each))) * v, np.uint8)
    step = len(flag) // v
    edge = np.append(np.searchsorted(q[order], rows), len(order))
    for k in range(0, len(rows), step):
        some = rows[k : k + step]
        mark = _spread(y.rest_begin[some], y.rest_begin[some + 1], y.rest, v * np.arange(len(some)))
        flag[mark] = 1
        pairs = order[edge[k] : edge[k + len(some)]]
        base = np.searchsorted(some, q[pairs]) * v
        for c in range(0, len(pairs), 1024):
            s = p[pairs[c : c + 1024]]
            found = np.cumsum(flag[_spread(begin[s], begin[s + 1], word, base[c : c + 1024])], dtype=np.int32)
            both[pairs[c : c + 1024]] += np.diff(np.append(np.int32(0), found)[_ends(length[s])])
        flag[mark] = 0
    return both


def _places(x: _Tile, y: _Tile) -> np.ndarray:
    """Where the words of ``x`` are among those of ``y``, else -1."""
    if not len(y.words):
        return np.full(len(x.words), -1)
    at = np.minimum(np.searchsorted(y.words, x.words), len(y.words) - 1)
    return np.where(y.words[at] == x.words, at, -1)


def _links(x: _Tile, y: _Tile, threshold: float, same: bool, later: bool, exact: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, target, weight) of the links between two tiles; with ``later``, from rows of ``x`` to earlier ones only.

    Weights are right if ``exact``, else at least the threshold."""
    held, n, places = [], 0, {}
    candidates = _candidates(x, y, threshold, same)
    while True:
        more = next(candidates, None)
        if more is not None:
            p, q = more
            s, t = x.seqs[p], y.seqs[q]
            good = t < s if later else t != s
            if same:  # a slice with itself has each pair twice
                good &= (p // SLICE != q // SLICE) | (t < s)
            held.append((p[good], q[good]))
            n += len(held[-1][0])
        if n and (more is None or n > HELD):
            p, q = map(np.concatenate, zip(*held))
            held, n = [], 0
            shared = _shared(x, y, threshold, exact, p, q, places)
            weight = shared / np.sqrt(x.sizes[p].astype(np.float64) * y.sizes[q])
            good = (weight >= threshold) & (shared > 0)
            if good.any():
                s, t = x.seqs[p[good]], y.seqs[q[good]]
                yield np.maximum(s, t), np.minimum(s, t), weight[good]
        if more is None:
            return


def _compare(threshold: float, later: bool, give: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``give`` gets all links of a task, as they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                pair = []
                for first in (0, 7):
                    # Tiles of the new rows are others than those of all rows.
                    key = (later and first, batch.column(first)[r].as_py())
                    held[key] = held.pop(key, None) or _Tile([batch.column(first + c)[r] for c in range(1, 7)])
                    pair.append(held[key])
                    while len(held) > KEPT:
                        del held[next(iter(held))]
                yield from _links(*pair, threshold, pair[0] is pair[1], later, give is _all)

    return lambda batches: give(run(batches))


def _all(links: Iterator) -> Iterator[pa.RecordBatch]:
    for s, t, w in links:
        for k in range(0, len(s), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 65536]) for c in (s, t, w)], ["source_seq", "target_seq", "weight"])


def _sources(links: Iterator) -> Iterator[pa.RecordBatch]:
    """The sources of a task's links, each once: at most as many as the task has rows."""
    found = np.empty(0, np.int64)
    for s, *_ in links:
        found = np.union1d(found, s)
    yield pa.RecordBatch.from_arrays([pa.array(found)], ["source_seq"])


def _counts(links: Iterator) -> Iterator[pa.RecordBatch]:
    """The number of a task's links."""
    yield pa.RecordBatch.from_arrays([pa.array([sum(len(s) for s, *_ in links)], pa.int64())], ["links"])


def _stars(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each end of the links (s, t) to the least that it is connected with."""
    ids, ends = np.unique(np.concatenate((s, t)), return_inverse=True)
    a, b = ends[: len(s)], ends[len(s) :]
    least = np.arange(len(ids))
    while True:
        m = np.minimum(least[a], least[b])
        new = least.copy()
        for k in (a, b, least[a], least[b]):
            np.minimum.at(new, k, m)
        new = new[new]
        if (new == least).all():
            break
        least = new
    some = np.flatnonzero(least != np.arange(len(ids)))
    return ids[some], ids[least[some]]


def _forest(links: Iterator) -> Iterator[pa.RecordBatch]:
    """Links that connect what ``links`` do: one for each row at most. No more than FOREST are held at a time."""
    held, n = [], 0
    for s, t, *_ in links:
        held.append((s, t))
        n += len(s)
        if n > FOREST:
            held = [_stars(*map(np.concatenate, zip(*held)))]
            n = len(held[0][0])
            if n > FOREST // 2:
                yield from _all_pairs(*held.pop())
                n = 0
    if held:
        yield from _all_pairs(*_stars(*map(np.concatenate, zip(*held))))


def _all_pairs(s: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(s), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(s[k : k + 65536]), pa.array(t[k : k + 65536])], ["source_seq", "target_seq"])


def _tiles(nodes: DataFrame, common: np.ndarray, centres: np.ndarray, rows: int) -> DataFrame:
    """The durable tiles of ``nodes``, dealt by group and size: rows of one group and of about as many words share tiles."""
    parts = max(8, math.ceil(rows / (4 * TILE)))
    kinds = _bags(nodes, _grouped(common, centres), "bag array<long>, kind int")
    dealt = kinds.repartition(parts, "seq").sortWithinPartitions("kind", F.size("bag"), "seq")
    return durable(dealt.mapInArrow(_pack(common), _TILE), "tiles")


def _joined(nodes: DataFrame, threshold: float, since: int | None, give: Callable, schema: str) -> DataFrame:
    rows = nodes.count()
    common = _common(nodes, rows)
    centres = _centres(nodes, rows, common)
    tiles = _tiles(nodes, common, centres, rows)
    left = tiles
    if since is not None:
        new = nodes.where(F.col("seq") >= since)
        left = _tiles(new, common, centres, new.count())
    x, y = (t.select(*(F.col(c).alias(f"{side}_{c}") for c in t.columns)) for t, side in ((left, "x"), (tiles, "y")))
    # A link has at least threshold ** 2 times as many words on one side as on the other.
    near = f"x_most >= {threshold * threshold - ROUND!r} * y_least and y_most >= {threshold * threshold - ROUND!r} * x_least"
    pairs = x.hint("shuffle_replicate_nl").join(y, F.expr(near if since is not None else f"x_tile <= y_tile and {near}"))
    pairs = pairs.select(*(f"{side}_{c}" for side in "xy" for c in tiles.columns if c not in ("least", "most")))
    return pairs.mapInArrow(_compare(threshold, since is not None, give), schema)


def auto_link(nodes: DataFrame, threshold: float = 0.3, since: int | None = None) -> DataFrame:
    """(source_seq, target_seq, weight) for each pair of nodes (seq, content, ...) of similarity ``threshold`` or more.

    The later node is the source; ``since`` asks for the links of nodes from that seq on only, and new nodes alone are
    then compared with all. A threshold of 0 or less switches linking off; nodes without words link with none."""
    if threshold <= 0:
        return nodes.sparkSession.createDataFrame([], LINKS)
    return _joined(nodes, threshold, since, _all, LINKS)


def link_forest(nodes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(source_seq, target_seq): links that connect the same nodes as those of :func:`auto_link`, in proportion to the
    nodes and not to the links. They lead from nodes to lesser ones and need not be links themselves."""
    schema = "source_seq long, target_seq long"
    if threshold <= 0:
        return nodes.sparkSession.createDataFrame([], schema)
    found = durable(_joined(nodes, threshold, None, _forest, schema), "forests")
    merge = lambda batches: _forest((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)
    return found.repartition(max(1, math.ceil(found.count() / FOREST)), "source_seq").mapInArrow(merge, schema)


def link_sources(nodes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(source_seq) of the links of :func:`auto_link`: a row for each source and task that finds a link of it, not one a link."""
    if threshold <= 0:
        return nodes.sparkSession.createDataFrame([], "source_seq long")
    return _joined(nodes, threshold, None, _sources, "source_seq long")


def link_counts(nodes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(links): rows that add up to the number of the links of :func:`auto_link`; they are counted where they are found."""
    if threshold <= 0:
        return nodes.sparkSession.createDataFrame([], "links long")
    return _joined(nodes, threshold, None, _counts, "links long")


def last_links(nodes: DataFrame, threshold: float = 0.3, step: int = TILE) -> DataFrame:
    """Those of :func:`auto_link` whose source is the last node that is a source.

    The last ``step`` nodes are compared with all first; the rest are only if none of those has a link."""
    before = nodes.select("seq").orderBy(F.desc("seq")).limit(step).agg(F.min("seq")).first()[0]
    for since in (before, None):
        links = durable(auto_link(nodes, threshold, since), "links")
        last = links.agg(F.max("source_seq")).first()[0]
        if last is not None:
            break
    return links.where(F.col("source_seq") == last) if last is not None else links
