"""Byte-level BPE encoding by replaying merges over the words of the corpus, and decoding.

Words are held together; an inverted index maps each token pair to the positions in them where it stands. The merges are
applied in rank order, each to all positions of its pair in all words, and only the pairs with the two touched
neighbours are entered anew.

1. The corpus's words are counted, and the VOCABULARY most frequent ones replayed, each once for the whole corpus, in
   shards of the vocabulary. Their ids go to all tasks in a broadcast of bounded size.
2. Texts are encoded by looking their words up. What is rarer is replayed where it stands, the words of a slice of
   texts together: such words are in few places, so looking them up would move more than it saves.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import segments
from quillgraph.llm.segments import Given, SegmentEncoder
from quillgraph.llm.words import slices, tidy
from quillgraph.plans.durable import discard, durable

#: Words that are replayed once for the corpus and broadcast, and bytes that these may have.
VOCABULARY, SHORT = 500_000, 32
#: Words that a task counts at a time.
COUNTED = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Applies the merges of ``ranks`` (token bytes to rank, which is the id) to many words together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.single = [ranks[bytes([b])] for b in range(256)]

    def _rank(self, pair: tuple[int, int]) -> int:
        """What ``pair`` merges to, or -1."""
        r = self.merged.get(pair)
        if r is None:
            r = self.merged[pair] = self.ranks.get(self.bytes[pair[0]] + self.bytes[pair[1]], -1)
        return r

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: always the pair of lowest rank first, the leftmost of equals."""
        token: list[int] = []
        right: list[int] = []  # the next live position of the word, or -1
        left: list[int] = []
        word: list[int] = []
        heads = []
        single, rank = self.single, self._rank
        index: dict[tuple[int, int], list[int]] = defaultdict(list)
        pairs: dict[int, set[tuple[int, int]]] = defaultdict(set)  # of a rank
        for w, b in enumerate(words):
            at, n = len(token), len(b)
            heads.append(at)
            token += [single[x] for x in b]
            right += range(at + 1, at + n + 1)
            left += range(at - 1, at + n - 1)
            word += [w] * n
            if n:
                right[-1] = left[at] = -1
            for p in range(at, at + n - 1):
                pair = (token[p], token[p + 1])
                if (r := rank(pair)) >= 0:
                    index[pair].append(p)
                    pairs[r].add(pair)
        due = list(pairs)
        heapq.heapify(due)
        while due:
            r = heapq.heappop(due)
            turn = pairs.pop(r, None)
            if not turn:
                continue
            if len(turn) == 1:
                places = sorted(index.pop(next(iter(turn))))
            else:
                places = sorted(p for pair in turn for p in index.pop(pair))
            late: set[int] = set()  # words in which a pair of lower rank has come up meanwhile
            for p in places:
                q = right[p]
                if token[p] < 0 or q < 0 or (token[p], token[q]) not in turn:
                    continue
                if late and word[p] in late:
                    pair = (token[p], token[q])
                    index[pair].append(p)
                    if not pairs[r]:
                        heapq.heappush(due, r)
                    pairs[r].add(pair)
                    continue
                token[p], token[q] = r, -1
                n = right[p] = right[q]
                if n >= 0:
                    left[n] = p
                for a, b in ((left[p], p), (p, n)):
                    if a >= 0 and b >= 0:
                        pair = (token[a], token[b])
                        k = rank(pair)
                        if k >= 0:
                            index[pair].append(a)
                            if k not in pairs or not pairs[k]:
                                heapq.heappush(due, k)
                            pairs[k].add(pair)
                            if k < r:
                                late.add(word[p])
        out = []
        for w, at in enumerate(heads):
            ids = []
            p = at if words[w] else -1
            while p >= 0:
                ids.append(token[p])
                p = right[p]
            out.append(ids)
        return out


class _Pieces:
    """Ids of distinct pieces of text, by one replay over their distinct words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.find = MergeReplay(ranks), regex.compile(pattern).findall

    def __call__(self, pieces: list[str]) -> list[bytes]:
        rows = [self.find(s) for s in pieces]
        words = list(set().union(*rows))
        ids: dict[str, bytes] = {}
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            ids.update((w, array("i", x).tobytes()) for w, x in zip(some, self.replay.words([w.encode() for w in some])))
        return [ids[r[0]] if len(r) == 1 else b"".join([ids[w] for w in r]) for r in rows]


_MADE: dict[tuple, _Pieces | SegmentEncoder] = {}


def _pieces(path: str, pattern: str) -> _Pieces:
    """The worker's, which remembers what pairs merge to."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = _Pieces(load_ranks(path), pattern)
    return _MADE[path, pattern]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): short words, with the space before them, that stand twice or more in what a task reads at a time."""

    def out() -> pa.RecordBatch:
        some = [(w, n) for w, n in seen.items() if n > 1]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

    seen: dict[bytes, int] = {}
    for batch in batches:
        for s in slices(batch.column(0), size=segments.SLICE):
            if not len(s.data):
                continue
            end, start, _ = segments.pieces(s)
            code, first, _, _ = segments.distinct(s, start, end)
            n = np.bincount(code)
            keep = np.flatnonzero(end[first] - start[first] <= SHORT)
            raw, get = s.data.tobytes(), seen.get
            for a, b, k in zip(start[first[keep]].tolist(), end[first[keep]].tolist(), n[keep].tolist()):
                w = raw[a:b]
                seen[w] = get(w, 0) + k
            if len(seen) > COUNTED:
                yield out()
                seen = {}
    yield out()


def _replayed(path: str, pattern: str):
    """Words with both their hashes and their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            s = segments.whole_rows(words)
            ids = _pieces(path, pattern)([w.decode() for w in words])
            yield pa.RecordBatch.from_arrays([s.hash_of(s.text[:-1], s.text[1:]).view(np.int64), s.second(s.text[:-1], s.text[1:]).view(np.int64), pa.array(ids, pa.binary())], ["h", "other", "ids"])

    return run


def vocabulary(docs: DataFrame, path: str, pattern: str, size: int = VOCABULARY) -> Given:
    """The ids of the ``size`` most frequent words of the corpus: at most ``size`` times SHORT ids, whatever its size."""
    words = durable(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(_counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = words if words.count() <= size else words.orderBy(F.desc("n"), "word").limit(size).repartition("word")
    ids = top.select("word").mapInArrow(tidy(_replayed(path, pattern)), "h long, other long, ids binary").toArrow()
    discard(words)
    h, other = (ids.column(c).to_numpy().view(np.uint64) for c in ("h", "other"))
    flat = ids.column("ids").to_pylist()
    return Given(h, other, np.array([len(x) // 4 for x in flat], np.int64), np.frombuffer(b"".join(flat), "<i4"))


def _encoding(docs: DataFrame, path: str, pattern: str, size: int):
    given = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, path, pattern, size))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name,) not in _MADE:
            for k in [k for k in _MADE if len(k) == 1]:  # of an earlier corpus
                del _MADE[k]
            _MADE[name,] = SegmentEncoder(_pieces(path, pattern), given=given.value)
        for batch in batches:
            for at, ids in _MADE[name,].column(batch.column(1)):
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    return run


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: b for b, i in load_ranks(path).items()}
        ordered = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        size = np.array([len(b) for b in ordered])
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        flat = np.frombuffer(b"".join(ordered), np.uint8)
        for batch in batches:
            out = []
            column = batch.column(1)
            values = column.values.to_numpy(zero_copy_only=False)
            offs = column.offsets.to_numpy()
            for a, b in zip(offs, offs[1:]):
                text = []
                for i in range(a, b, 1 << 18):
                    ids = values[i : min(b, i + (1 << 18))]
                    n = size[ids]
                    ends = np.cumsum(n)
                    text.append(flat[np.repeat(begin[ids] - ends + n, n) + np.arange(ends[-1])].tobytes())
                out.append(b"".join(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, size: int = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of the texts of ``docs`` (doc_id, text, ...); null and empty texts give no ids.

    ``pattern`` splits the text, ``path`` has the ranks; no special tokens. Rows keep their number and order; null or
    repeated doc_ids pass through; an empty table gives no rows."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_encoding(docs, path, pattern, size)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column decoded: the bytes of the ids, empty for no ids."""
    return encoded.select("doc_id", "ids").mapInArrow(tidy(_decoding(path)), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, size: int = VOCABULARY) -> DataFrame:
    """:func:`decode` of :func:`encode` in one pass of the executors' Python."""
    there, back = _encoding(docs, path, pattern, size), _decoding(path)
    return docs.select("doc_id", "text").mapInArrow(tidy(lambda batches: back(there(batches))), "doc_id long, ids array<int>, decoded binary")
