"""Toxicity by a counterfactually regularised classifier.

A logistic regression on the presence of words and word beginnings. Besides the log-loss it minimises the squared
change of the score between counterfactuals of a labelled text, so that terms which merely name a group carry little
weight of their own. If the text names a group, its counterfactual names another one. If it names none, a mention is
planted: with and without it, and with another group in its place, the text should score alike. So there are pairs in
every corpus, also in one that names no group, where they keep beginnings of words that identity terms share with
insults from counting against the terms. It is fitted on a bounded sample of the labelled rows; statistics and scores
run distributed over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillgraph.llm.words import Slice, mix, slices, tidy
from quillgraph.plans.durable import discard, durable

#: Labelled rows that the classifier is fitted on at most. All that is learnt is bounded by it.
SAMPLE = 30_000
#: Documents that a feature needs, and how many standard deviations their toxic share must be from the share at large.
LEAST, FAR = 5, 4
#: Beginnings of words, in bytes, that are features beside the words.
PREFIXES = (4, 5, 6)
#: A row counts as toxic from this score on.
CUT = 0.3
#: Terms that are swapped within their line, in the languages of the corpus.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("immigrants", "natives", "refugees"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("american", "german", "french", "spanish", "chinese", "mexican", "african"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "atheisten"), ("schwule", "lesben"), ("türken", "polen", "syrer", "deutsche"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "athées"), ("noirs", "blancs", "arabes", "asiatiques"), ("immigrés", "réfugiés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "ateos"), ("negros", "blancos", "latinos", "gitanos"), ("inmigrantes", "refugiados"),
)
_U = np.uint64
_WORD = re.compile("[a-zß-öø-ÿ]+")
_TERMS = [t for line in IDENTITY for t in line]
_NEXT = {t: line[(i + 1) % len(line)] for line in IDENTITY for i, t in enumerate(line)}


class Model(NamedTuple):
    """``weights`` of the sorted feature ``hashes``."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def _hashes(s: Slice) -> list[np.ndarray]:
    """Hashes of each word stripped of ASCII marks, and of its beginnings (0: it has none of that length)."""
    mark = np.zeros(256, bool)
    mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    # The nearest byte that is no mark, from each byte on and back to it.
    at = np.arange(len(s.data))
    after = np.minimum.accumulate(np.where(mark[s.data], len(s.data), at)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(mark[s.data], -1, at))
    start = np.minimum(after[s.start], s.end)
    end = np.maximum(before[s.end - 1] + 1, start)
    out = [s.hash_of(start, end)]
    out[0][start == end] = 0
    for k in PREFIXES:
        h = mix(s.hash_of(start, np.minimum(start + k, end)) + _U(k))
        h[end - start < k] = 0
        out.append(h)
    return out


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, text of each feature, feature) for slices of a column; with repetitions."""
    for s in slices(column, lower=True):
        n = len(s.first) - 1
        row = np.repeat(np.arange(n), np.diff(s.first))
        for h in _hashes(s) if len(row) else []:
            yield s.at, n, row[h != 0], h[h != 0]
        if not len(row):
            yield s.at, n, row, np.zeros(0, _U)


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature: all, and the toxic ones."""
    for batch in batches:
        toxic = batch.column(1).to_numpy().astype(bool)
        for at, _, row, h in _features(batch.column(0)):
            row, h = _distinct(row, h)
            f, i = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([f.view(np.int64), np.bincount(i, minlength=len(f)).astype(np.int64), np.bincount(i, toxic[at + row], len(f)).astype(np.int64)], ["f", "n", "t"])


def _word_hash(word: str) -> int:
    return next(h for _, _, _, h in _features(pa.array([word])))[0]


def swap(text: str) -> str | None:
    """``text``, lower-cased, with each identity term replaced by the next of its line; None if there is none."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    new = _WORD.sub(lambda m: _NEXT.get(m[0], m[0]), text)
    return new if new != text else None


def _known(hashes: np.ndarray, column: pa.Array) -> list[list[int]]:
    """Indices of the features of ``hashes`` (sorted) that each text has."""
    out: list[set[int]] = [set() for _ in range(len(column))]
    for at, _, row, h in _features(column):
        i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[i] == h
        for r, k in zip((at + row[hit]).tolist(), i[hit].tolist()):
            out[r].add(k)
    return [sorted(x) for x in out]


def _designed(hashes: np.ndarray):
    """(toxic, features, features of the counterfactual or null, a number that chooses the planted mention)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column(0).to_pylist()
            other = [swap(x) if x else None for x in texts]
            own, swapped = _known(hashes, batch.column(0)), _known(hashes, pa.array(other, pa.string()))
            swapped = [x if o is not None else None for x, o in zip(swapped, other)]
            pick = [zlib.crc32((x or "").encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, kind), pa.array(swapped, kind), pa.array(pick, pa.int64())], ["toxic", "own", "swapped", "pick"])

    return run


def pairs_of(own: list[list[int]], swapped: list[list[int] | None], pick: list[int], terms: list[list[int]]) -> Counter:
    """How often each pair of counterfactuals differs in which features: (only the one has them, only the other has).

    ``terms`` are the features of each identity term; where nothing is swapped the text is paired with itself after a
    planted mention, and that with one of the next term."""
    place = {t: i for i, t in enumerate(_TERMS)}
    out: Counter = Counter()

    def add(a: set, b: set) -> None:
        out[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1

    for x, y, k in zip(own, swapped, pick):
        have = set(x)
        if y is not None:
            add(have, set(y))
            continue
        one = k % len(_TERMS)
        planted, other = have | set(terms[one]), have | set(terms[place[_NEXT[_TERMS[one]]]])
        add(planted, have)
        add(planted, other)
    return out


def solve(own: list[list[int]], pairs: Counter, y: np.ndarray, size: int, fairness: float = 1.0, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log-loss + ridge + fairness * mean squared change of the logit over ``pairs``."""
    flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter((k for r in rows for k in r), np.int64))
    row, col = flat(own)
    row_a, col_a = flat([a for a, _ in pairs])
    row_b, col_b = flat([b for _, b in pairs])
    times = np.array(list(pairs.values()), float)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(own)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(col, err[row], size) + ridge * w[:-1], err.sum())
        if len(times):
            d = (np.bincount(row_a, w[col_a], len(pairs)) - np.bincount(row_b, w[col_b], len(pairs))) * times * (2 * fairness / times.sum())
            grad[:-1] += np.bincount(col_a, d[row_a], size) - np.bincount(col_b, d[row_b], size)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = 1.0) -> Model:
    """The model of the rows of ``labels`` (doc_id, toxic), at most ``sample`` of them, whose texts ``docs`` has.

    Which ones is decided by a hash of doc_id. A label that repeats a doc_id counts as toxic if one of them is, a
    document that does has its least text here. Without labelled texts all scores are 0, with one class its share."""
    some = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = durable(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = durable(texts.select("text", "toxic"), "labelled")
    total, toxic = texts.agg(F.count("*"), F.sum("toxic")).first()
    share = (toxic or 0) / total if total else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, _U), np.zeros(0), -40.0 if share == 0 else 40.0)
    counts = texts.mapInArrow(tidy(_counts), "f long, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(f"n >= {LEAST}")
    # How far the toxic share among documents with the feature is from the share at large, in standard deviations.
    far = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counts.withColumn("far", far).where(f"abs(far) >= {FAR}").select("f").collect()
    hashes = np.unique(np.array([*(np.int64(r["f"]).view(_U) for r in best), *map(_word_hash, _TERMS)], _U))
    rows = texts.mapInArrow(tidy(_designed(hashes)), "toxic int, own array<int>, swapped array<int>, pick long").collect()
    for t in (some, texts):
        discard(t)
    own = [r["own"] for r in rows]
    pairs = pairs_of(own, [r["swapped"] for r in rows], [r["pick"] for r in rows], _known(hashes, pa.array(_TERMS)))
    weights, bias = solve(own, pairs, np.array([float(r["toxic"]) for r in rows]), len(hashes), fairness)
    return Model(hashes, weights, bias)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with its score in the column ``name``, from the column text alone; null texts count as empty."""
    hashes, weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 20, bool)
        seen[(hashes & _U((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for at, n, row, h in _features(batch.column("text")) if len(hashes) else ():
                maybe = seen[(h & _U((1 << 20) - 1)).astype(np.int64)]
                row, h = row[maybe], h[maybe]
                i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[i] == h
                row, i = _distinct(row[hit], i[hit])
                z[at : at + n] += np.bincount(row, weights[i], n)
            value = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Rows that labels are not learnt from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; learns from the labels that are not held out.

    Null and empty texts have the score of no words at all; rows with a null or repeated doc_id are scored each by its
    own text, null ones count as not held out; an empty table gives no rows. Other columns play no part."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose texts score below ``cut``, with all their columns; learns as above.

    Rows are kept or dropped one by one, whatever repeats; an empty table stays empty."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).where(F.col(name) < cut).drop(name)
