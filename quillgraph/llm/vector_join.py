"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors a, b with cosine >= t have a squared distance of at most 2 - 2t. A rotation spreads it over B blocks of
dimensions, and at least one block holds at most its share (2 - 2t) / B. So for each block there is a range join under
that budget; the union of what the blocks find is verified on the full vectors in double precision.

A label of up to WIDE vectors is one cell, in which all blocks are joined. A larger one is cut, for each block, into
cells of the block's first axes, as many axes as its size asks for; vectors also fall into the neighbour cells that lie
within the budget. There a pair is taken in the first block whose budget it keeps and in one cell only. Cells of any
size are compared in pairs of bounded tiles; tasks give back counts of links and a spanning forest of them, never the
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.groups import grouped
from quillgraph.llm.words import mix
from quillgraph.operators.components import connected_components
from quillgraph.plans.durable import checked_broadcast, discard, durable

#: Dimensions of a block, rows of a tile, rows up to which a label is one cell, and rows that a cell of a larger one
#: should hold about. A row of a cell of c rows is dealt out c / TILE times; axes deal it out 8 * 1.5 ** axes times. At
#: WIDE both come to the same.
BLOCK, TILE, WIDE, CELL = 8, 4096, 500_000, 16_384
_U = np.uint64


def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def _blocks(dim: int) -> np.ndarray:
    """Where each block starts, and the end."""
    n = max(1, dim // BLOCK)
    return np.linspace(0, dim, n + 1).astype(int)


def _budget(threshold: float, blocks: int) -> float:
    return (2 - 2 * threshold) / blocks * (1 + 1e-9) + 1e-12


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(2):
            v = None
            if x.is_valid and len(x.values) and not x.values.null_count:
                a = x.values.to_numpy(zero_copy_only=False).astype("<f8")
                with np.errstate(over="ignore", invalid="ignore"):
                    square = float((a * a).sum())
                if np.isfinite(a).all() and a.any():
                    if not 1e-200 < square < 1e200:  # the norm over- or underflows: only the direction counts
                        a = a / np.abs(a).max()
                    v = a.tobytes()
            out.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "v"])


def _cells(threshold: float):
    """(key, id, home, block) for the cells of each vector (id, label, axes, v): of all blocks (-1), or of each one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            ids, label, axes = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64).view(_U), batch.column(2).to_numpy()
            dims = np.array([len(x) // 8 for x in raw], np.int64)
            for dim, n_axes in {*zip(dims.tolist(), axes.tolist())}:
                rows = np.flatnonzero((dims == dim) & (axes == n_axes))
                salt = label[rows] * _U(0x9E3779B97F4A7C15) + _U(dim * 1_000_003)
                if not n_axes:
                    yield pa.RecordBatch.from_arrays([mix(salt).view(np.int64), ids[rows], pa.array(np.ones(len(rows), bool)), np.full(len(rows), -1, np.int64)], ["key", "id", "home", "block"])
                    continue
                y = _unit(np.frombuffer(b"".join([raw[i] for i in rows]), "<f8").reshape(-1, dim)) @ _rotation(dim)
                at = _blocks(dim)
                r = math.sqrt(_budget(threshold, len(at) - 1))
                wide = 4 * r
                for b in range(len(at) - 1):
                    which, home = np.arange(len(rows)), np.ones(len(rows), bool)
                    key = mix(salt + _U(b + 1))
                    for a in range(at[b], min(at[b] + n_axes, at[b + 1])):
                        x = y[which, a] / wide
                        cell = np.floor(x)
                        low, high = (x - cell) * wide <= r, (cell + 1 - x) * wide <= r
                        cell = np.concatenate((cell, cell[low] - 1, cell[high] + 1))
                        key = np.concatenate((key, key[low], key[high]))
                        home = np.concatenate((home, np.zeros(low.sum() + high.sum(), bool)))
                        which = np.concatenate((which, which[low], which[high]))
                        key = mix(key * _U(0x2545F4914F6CDD1D) + cell.astype(np.int64).view(_U))
                    yield pa.RecordBatch.from_arrays([key.view(np.int64), ids[rows[which]], pa.array(home), np.full(len(key), b, np.int64)], ["key", "id", "home", "block"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that the links reach."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _near(x: np.ndarray, y: np.ndarray, at: np.ndarray, blocks: range, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` and ``y`` that keep the budget in one of the blocks.

    The ranges are joined in single precision with room for its error; what is verified later is exact."""
    near = np.zeros((len(x), len(y)), bool)
    for b in blocks:
        p, q = x[:, at[b] : at[b + 1]], y[:, at[b] : at[b + 1]]
        # |p|^2 + |q|^2 - 2 pq <= most, as a product
        p = np.concatenate((-2 * p, (p * p).sum(1, keepdims=True), np.ones((len(p), 1))), 1).astype(np.float32)
        q = np.concatenate((q, np.ones((len(q), 1)), (q * q).sum(1, keepdims=True)), 1).astype(np.float32)
        near |= p @ q.T <= np.float32(most + 1e-5)
    return np.nonzero(near)


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            _, i, j, block = (t.column(c)[0].as_py() for c in range(4))
            part, ids, home, weight = (t.column(c).to_numpy() for c in (4, 5, 6, 7))
            v = np.frombuffer(b"".join(t.column(8).to_pylist()), "<f8").reshape(len(ids), -1)
            norm = np.sqrt((v * v).sum(1))
            y = (v / norm[:, None]) @ _rotation(v.shape[1])
            at = _blocks(v.shape[1])
            most = _budget(threshold, len(at) - 1)
            left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            blocks = range(len(at) - 1) if block < 0 else range(block, block + 1)
            n, least = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for s in range(0, len(left), 256):
                x = left[s : s + 256]
                other = right[s:] if i == j else right
                p, q = _near(y[x], y[other], at, blocks, most)
                p, q = x[p], other[q]
                once = (p < q) if i == j else np.ones(len(p), bool)
                # Both at home here, or the one at home has the smaller id: so each pair meets once.
                once &= (home[p] & home[q]) | (home[p] & ~home[q] & (ids[p] < ids[q])) | (~home[p] & home[q] & (ids[q] < ids[p]))
                p, q = p[once], q[once]
                for k in range(0, len(p), 16384):
                    a, b = p[k : k + 16384], q[k : k + 16384]
                    if block >= 0:
                        share = np.add.reduceat((y[a] - y[b]) ** 2, at[:-1], axis=1)
                        first = (share <= most + 1e-9).argmax(1) == block
                        a, b = a[first], b[first]
                    linked = (v[a] * v[b]).sum(1) / (norm[a] * norm[b]) >= threshold
                    a, b = a[linked], b[linked]
                    n += np.bincount(a, weight[b], len(ids)).astype(np.int64) + np.bincount(b, weight[a], len(ids)).astype(np.int64)
                    # A forest of the links so far and these: memory does not grow with the links.
                    least = _forest(np.concatenate((a, np.arange(len(ids)))), np.concatenate((b, least)), len(ids)) if len(a) else least
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([ids[some], ids[least[some]], n[some]], ["id", "other", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, wide: int = WIDE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label, ...).

    Vectors are linked if labels are equal and not null and the cosine is ``threshold`` or more. Null or zero vectors,
    ones with null or non-finite components and rows without vec_id link with nothing: no links, their own component,
    kept. Vectors of different length do not link. Equal vectors are compared once and counted all. Rows that repeat a
    vec_id are vectors of their own, each with its own links; the least vec_id of a component names it. An empty table
    gives no rows."""
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    rows = durable(rows.mapInArrow(_valid, "vec_id long, label long, v binary"), "vectors")
    good = "vec_id is not null and label is not null and v is not null"
    classes = rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    classes = durable(classes.withColumn("id", F.monotonically_increasing_id()), "vec-classes")  # numbered once, as written
    sizes = classes.groupBy("label").count()
    axes = F.when(F.col("count") <= wide, 0).otherwise(F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.ceil(F.log(F.col("count") / cell) / math.log(2.2)))))
    axes = durable(sizes.select("label", axes.cast("int").alias("axes")), "axes")
    placed = classes.join(checked_broadcast(axes), "label").select("id", "label", "axes", "v")
    cells = durable(placed.mapInArrow(_cells(threshold), "key long, id long, home boolean, block long"), "cells")
    size = durable(cells.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("home").cast("int")).alias("h")).where("c > 1 and h = 1").selectExpr("key", f"cast(ceil(c / {tile}) as int) t"), "cell-size")
    dealt = cells.join(size, "key").withColumn("part", F.expr("pmod(xxhash64(id), t)")).withColumn("other", F.explode(F.expr("sequence(0, t - 1)")))
    dealt = dealt.selectExpr("key", "cast(least(part, other) as long) i", "cast(greatest(part, other) as long) j", "block", "cast(part as long) part", "id", "home")
    dealt = dealt.join(classes.select("id", "w", "v"), "id").select("key", "i", "j", "block", "part", "id", "home", "w", "v").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = durable(dealt.mapInArrow(_compare(threshold), "id long, other long, n long"), "vec-links")
    for t in (cells, size, axes):
        discard(t)
    comp = durable(connected_components(found.select("id", "other").distinct(), "id", "other"), "vec-comp")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    # Components are of classes; the least vec_id of their classes names them.
    of_class = classes.join(links, "id", "left").join(comp, "id", "left").withColumn("c", F.coalesce("component", "id"))
    of_class = durable(of_class.select("label", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "c"), "of-class")
    names = durable(of_class.groupBy("c").agg(F.min("least").alias("component_id")), "names")
    linked = rows.where(good).join(of_class.join(names, "c").select("label", "v", "n_links", "component_id"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(f"not ({good})").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
