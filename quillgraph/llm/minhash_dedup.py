"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts gives each document the size and a commutative 128-bit fingerprint of its shingle set and
   a MinHash signature. Documents with equal sets fold into one class.
2. Signatures are cut into bands. In each bucket every member is compared with the bucket's smallest class, a star,
   and not with every other member. What remains apart after that is compared across the components of the bucket, in
   pairs of bounded chunks that only emit verified links; pairs inside one component need no test, they cannot change
   the classes.
3. A pair's signatures are compared batch by batch. With m of k values equal and a uniform prior, the similarity has
   the posterior Beta(m + 1, k - m + 1); the pair is dropped as soon as P(similarity >= threshold) falls below
   ``miss``. Survivors are verified on their full shingle sets: inter * 100 >= percent * union.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.groups import grouped
from quillgraph.llm.words import mix, shingle_set, slices, tidy
from quillgraph.operators.components import connected_components
from quillgraph.plans.durable import checked_broadcast, discard, durable

WORDS = 5
#: 25 bands of 5 values: a pair of similarity 0.85 meets in no band with probability 4e-7, one of 0.8 with 5e-5.
BANDS, ROWS = 25, 5
#: Values that a verification step compares.
BATCH = 16
#: Probability below which a pair counts as not similar enough.
MISS = 1e-7
#: Members of a bucket's chunk: a bucket of any size is compared in pairs of chunks.
CHUNK = 512
_U = np.uint64
_SIGN = "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary"


def _hashers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(5)
    n = BANDS * ROWS
    return r.integers(0, 2**31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.int64).astype(np.uint32)


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> _U(32)).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (a[:, None] * x[None, i : i + 512] + b[:, None]).min(1), out=out)
    return out


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashers()
        for batch in batches:
            n = batch.num_rows
            size, fp1, fp2, sig = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U), []
            for s in slices(batch.column(1), lower=True):
                for i in range(len(s.first) - 1):
                    x = shingle_set(s.hash[s.first[i] : s.first[i + 1]], words)
                    size[s.at + i] = len(x)
                    if len(x):
                        fp1[s.at + i], fp2[s.at + i] = np.add.reduce(mix(x)), np.add.reduce(mix(x ^ _U(0xA5A5A5A55A5A5A5A)))
                    sig.append(_signature(x, a, b).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, fp1.view(np.int64), fp2.view(np.int64), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return run


def _band_keys(sig: np.ndarray, salt: np.ndarray) -> np.ndarray:
    v = sig.reshape(len(sig), BANDS, ROWS).astype(_U)
    key = np.broadcast_to(salt, (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * _U(0x2545F4914F6CDD1D) + v[:, :, k])
    return key


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=_U))
    for batch in batches:
        n = batch.num_rows
        if n:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, -1)
            key = _band_keys(sig, salt)
            yield pa.RecordBatch.from_arrays([key.ravel().view(np.int64), np.repeat(batch.column(0).to_numpy(), BANDS)], ["key", "id"])


def least_matches(threshold: float, miss: float, size: int = BANDS * ROWS) -> np.ndarray:
    """For each number k of compared values the least number of equal ones with which a pair goes on."""
    out = np.zeros(size + 1, np.int64)
    for k in range(1, size + 1):
        tail, m = 0.0, 0  # P(similarity >= t | m of k) = P(Binomial(k + 1, t) <= m)
        for m in range(k + 1):
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if tail >= miss:
                break
        out[k] = m
    return out


def _prune(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            live, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k in range(0, BANDS * ROWS, BATCH):
                to = min(k + BATCH, BANDS * ROWS)
                equal[live] += (x[live, k:to] == y[live, k:to]).sum(1)
                live = live[equal[live] >= least[to]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(live), batch.column(1).take(live)], ["a", "b"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in slices(batch.column(1), lower=True):
                out += [shingle_set(s.hash[s.first[i] : s.first[i + 1]], words).tobytes() for i in range(len(s.first) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "s"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), _U) for c in (2, 3))
                both = np.concatenate((x, y))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _across(percent: int, miss: float):
    """Links between different components of a bucket's two chunks; each pair in its first common band only."""
    least = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=_U))
        for t in grouped(batches, 3):
            key, i, j = (t.column(c)[0].as_py() for c in range(3))
            part, ids, g = (t.column(c).to_numpy() for c in (3, 4, 5))
            sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint32).reshape(len(ids), -1)
            sets = [np.frombuffer(x, _U) for x in t.column(7).to_pylist()]
            band = _band_keys(sig, salt)
            here = (band == np.array(key, np.int64).view(_U)).argmax(1)  # the band of this bucket
            size = np.array([len(x) for x in sets])
            found: list[tuple[int, int]] = []
            for x in np.flatnonzero(part == i):
                y = np.flatnonzero((part == j) & (g != g[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
                if i == j:
                    y = y[y > x]
                equal = np.zeros(len(y), np.int64)
                for k in range(0, BANDS * ROWS, BATCH):
                    to = min(k + BATCH, BANDS * ROWS)
                    equal += (sig[y, k:to] == sig[x, k:to]).sum(1)
                    live = equal >= least[to]
                    y, equal = y[live], equal[live]
                if len(y):
                    y = y[(band[y] == band[x]).argmax(1) == here[x]]
                found += [(x, z) for z in y]
            if found:
                p = np.array(found)
                inter = _intersections(sets, p)
                p = p[100 * inter >= percent * (size[p[:, 0]] + size[p[:, 1]] - inter)]
                if len(p):
                    yield pa.RecordBatch.from_arrays([ids[p[:, 0]], ids[p[:, 1]]], ["a", "b"])

    return run


def _intersections(sets: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs ``p``; by a 0/1 matrix if there are many of them."""
    if len(p) <= 4 * len(sets):
        both = (np.sort(np.concatenate((sets[a], sets[b]))) for a, b in p)
        return np.array([int((x[1:] == x[:-1]).sum()) for x in both])
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, cols, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, cols = rows[count[cols] > 1], cols[count[cols] > 1]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    inter = np.zeros((len(sets), len(sets)), np.float64)
    for c in range(0, len(count), 8192):
        lo, hi = np.searchsorted(cols, (c, c + 8192))
        m = np.zeros((len(sets), 8192), np.float32)
        m[rows[lo:hi], cols[lo:hi] - c] = 1
        inter += m @ m.T
    return inter[p[:, 0], p[:, 1]].astype(np.int64)


def _full_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, s): the shingle sets of the texts of ``ids``, a table of one column doc_id."""
    ids = durable(ids, "ids")
    texts = docs.join(checked_broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")
    return durable(texts.mapInArrow(tidy(_sets(words)), "id long, s binary").dropDuplicates(["id"]), "sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """Links among the distinct candidate ``pairs`` (a, b)."""
    sig = classes.select("id", "sig")
    both = pairs.join(sig.withColumnsRenamed({"id": "a", "sig": "x"}), "a").join(sig.withColumnsRenamed({"id": "b", "sig": "y"}), "b")
    alive = durable(both.select("a", "b", "x", "y").mapInArrow(tidy(_prune(percent / 100, miss)), "a long, b long"), "pairs")
    ends = durable(alive.select(F.col("a").alias("doc_id")).union(alive.select("b")).distinct(), "ends")
    sets = _full_sets(ends, docs, words)
    full = alive.join(sets.withColumnsRenamed({"id": "b", "s": "y"}), "b").join(sets.withColumnsRenamed({"id": "a", "s": "x"}), "a")
    links = durable(full.select("a", "b", "x", "y").mapInArrow(tidy(_verify(percent)), "a long, b long"), "links")
    for t in (alive, ends, sets):
        discard(t)
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, ...).

    Null or wordless texts have the empty set: linked with nothing, their own component, kept. Rows without doc_id
    link with nothing and have a null component; they are kept. A doc_id is taken as unique: rows that repeat one
    are one document and get one class. Ties go to the smallest doc_id."""
    signed = durable(docs.select("doc_id", "text").mapInArrow(tidy(_sign(words)), _SIGN), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = durable(some.groupBy("n_shingles", "fp1", "fp2").agg(F.min(F.struct("doc_id", "sig")).alias("x")).selectExpr("fp1", "fp2", "x.doc_id id", "x.sig"), "classes")
    bands = durable(classes.select("id", "sig").mapInArrow(tidy(_band), "key long, id long"), "bands")
    heads = durable(bands.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c"), "heads")
    # Only buckets with two classes or more go on; the join is between two written tables, so hot buckets can be split.
    members = durable(bands.join(heads, "key"), "members")
    discard(bands)
    pairs = durable(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "star")
    links = _confirmed(pairs, classes, docs, words, percent, miss)
    for x in (heads, pairs):
        discard(x)
    comp = durable(connected_components(links, "a", "b"), "comp")
    mixed = durable(members.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g")), "mixed")
    several = mixed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("c")).where("lo <> hi and c > 2")
    several = durable(several.selectExpr("key", f"cast(ceil(c / {CHUNK}) as int) t"), "several")
    rest = durable(mixed.join(several, "key").selectExpr("key", "t", "id", "g", f"pmod(xxhash64(id), t) part"), "rest")
    if not rest.isEmpty():
        sets = _full_sets(rest.select(F.col("id").alias("doc_id")).distinct(), docs, words)
        sig = classes.select("id", "sig").join(sets, "id")
        # Chunk i meets chunk j in the group (key, min, max).
        dealt = rest.withColumn("other", F.explode(F.expr("sequence(0, t - 1)"))).selectExpr("key", "cast(least(part, other) as long) i", "cast(greatest(part, other) as long) j", "cast(part as long) part", "id", "g")
        dealt = dealt.join(sig, "id").select("key", "i", "j", "part", "id", "g", "sig", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = durable(dealt.mapInArrow(tidy(_across(percent, miss)), "a long, b long"), "across")
        if not more.isEmpty():
            comp = durable(connected_components(links.union(more), "a", "b"), "comp")
    of_set = durable(classes.select("fp1", "fp2", "id").join(comp, "id", "left").select("fp1", "fp2", F.coalesce("component", "id").alias("component_id")), "of-set")
    some = some.select("doc_id", "n_shingles", "fp1", "fp2").join(of_set, ["fp1", "fp2"]).select("doc_id", "n_shingles", "component_id")
    none = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.expr("doc_id <=> component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id. Rows without doc_id stay.

    Rows that repeat a doc_id are one document; one of them stays."""
    found = durable(near_duplicates(docs, percent, words).select("doc_id", "kept"), "found")
    gone = durable(found.where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(docs.columns)
    repeated = durable(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(checked_broadcast(repeated), "doc_id", "left_anti").select(docs.columns)
    return once.union(left.join(checked_broadcast(repeated), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
