"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

The packing is global and yet planned on a few numbers: it depends only on how many pieces there are of each length.
The driver plans bins on that histogram, which has as many entries as a sequence has tokens, whatever the corpus holds:
fill a bin greedily with the largest pieces that fit; then, as long as it leaves a gap, replace its smallest piece
with the two unpacked ones that fill the widened gap best; then repeat that bin as often as the supply lasts. A piece
finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.words import tidy
from quillgraph.llm.tokenizing import encoder
from quillgraph.plans.durable import checked_broadcast, durable

SEQUENCE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _best_two(free: np.ndarray, room: int) -> tuple[int, int]:
    """The lengths a >= b with the largest sum up to ``room`` of which ``free`` has pieces; (0, 0) if none."""
    n = min(len(free) - 1, room)
    lengths = np.arange(n + 1)
    top = np.maximum.accumulate(np.where(free[: n + 1] > 0, lengths, 0))  # largest free length up to each
    a = np.flatnonzero(free[: n + 1] > 0)
    b = top[np.minimum(a, room - a)]
    same = (b == a) & (free[a] < 2)
    b = np.where(same, top[np.maximum(b - 1, 0)], b)
    a, b = a[b > 0], b[b > 0]
    if not len(a):
        return 0, 0
    k = int(np.argmax(a + b))
    return int(a[k]), int(b[k])


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first number, count, sequence of the first, offset): where the pieces of each length go, by number."""
    free = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        free[length] = count
    given, slots, sequence = np.zeros(capacity + 1, np.int64), [], 0
    while free.any():
        bin_: list[int] = []
        left = free.copy()
        gap = capacity
        while gap and (fit := np.flatnonzero(left[: gap + 1])).size:
            length = int(fit[-1])
            k = min(int(left[length]), gap // length)
            bin_ += [length] * k
            left[length] -= k
            gap -= k * length
        while gap and bin_:
            small = bin_[-1]
            a, b = _best_two(left, gap + small)
            if a + b <= small:
                break
            left[small] += 1
            left[a] -= 1
            left[b] -= 1
            bin_ = sorted([*bin_[:-1], a, b], reverse=True)
            gap += small - a - b
        lengths, used = np.unique(bin_, return_counts=True)
        times = int((free[lengths] // used).min())
        free[lengths] -= times * used
        offset = 0
        for length in bin_:
            slots.append((length, given[length], times, sequence, offset))
            given[length] += times
            offset += length
        sequence += times
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces of the documents' ids: a document longer than a sequence is cut from its end into full ones.

    Null texts count as empty and have the end id only. ``nth`` numbers the pieces of a length within their task, so
    the table must be written before use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, tail = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.array([end_id], "<i4").tobytes()
        encoder(tokenizer).forget()  # what an earlier task left
        for batch in batches:
            for at, rows in encoder(tokenizer).column(batch.column(1)):
                out, which = [], []
                for i, ids in enumerate(rows):
                    ids += tail
                    n = len(ids) // 4
                    first = n % capacity or min(n, capacity)
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if piece == 0 else capacity
                        out.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                        seen[length] += 1
                        which.append(at + i)
                c = np.array(out, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), c[:, 0].astype(np.int32), c[:, 1].copy(), c[:, 2].copy(), c[:, 3].copy(), pa.array(np.full(len(c), part, np.int32)), c[:, 4].copy()], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        encoder(tokenizer).forget()  # other stages share the worker

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)


def pack(table: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``table`` of pieces, as :func:`pieces` gives it and written, with sequence_id and offset for part and nth."""
    counts = durable(table.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    slots = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = durable(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "base")
    numbered = table.join(checked_broadcast(base), ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base")).drop("part", "base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = int(slots[:, 1].max(initial=0)) + 1
        keys = slots[:, 0] * wide + slots[:, 1]
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            s = slots[np.searchsorted(keys, length * wide + np.minimum(nth, wide - 1), "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s[:, 3] + nth - s[:, 1]), pa.array(s[:, 4].copy())], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text, ...)."""
    return pack(durable(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
