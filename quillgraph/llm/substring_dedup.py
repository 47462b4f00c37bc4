"""Removal of passages that recur anywhere in the corpus, by repeated-phrase automata.

A window is WINDOW consecutive words. Its anchor is the smallest hash among its ANCHOR-word phrases; equal windows have
equal anchors, so only phrases that occur twice or more in the corpus can belong to recurring windows.

1. Each text gives its distinct anchors, about one in twelve words. Phrases that stand in two places are confirmed.
2. The confirmed phrases are dealt to shards of about SHARD of them, those first seen in one text together. Each shard
   compiles an Aho-Corasick automaton over words from its phrases, and the chunks of the documents are streamed through
   it; the automaton alone says where phrases stand. A document goes through the shards that hold phrases of its
   anchors; through the others it need not go, nothing of theirs can be the anchor of one of its windows.
3. The windows around the occurrences are confirmed: neighbouring windows with one anchor form a run. A run whose words
   recur as a whole is done; of anchors with other runs each window is counted by itself. Words are compared by
   128-bit digests.
4. Words covered by confirmed windows go.

Documents with equal texts are handled once: of these all windows recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import Slice, _powers, grams, mix, slices, tidy
from quillgraph.plans.durable import BROADCAST_ROWS, checked_broadcast, discard, durable

WINDOW, ANCHOR = 35, 12
#: Phrases that an automaton holds about, words of a chunk that is streamed through it, and of a shard's part.
SHARD, CHUNK, PART = 60_000, 4096, 2_000_000
#: Letters that words are mapped to.
LETTERS = 64
#: A text's phrases share a shard, one for each so many of its words.
SPREAD = 100_000
_U = np.uint64
_EMPTY = hashlib.sha256(b"").hexdigest()
_FIRST = "doc_id long, key binary, n_words long, sha string, anchors array<long>"
_RUN = {"rid": "long", "anchor": "long", "start": "int", "size": "int", "whole": "long", "whole2": "long", "windows": "array<long>", "windows2": "array<long>"}
_RUNS = ", ".join(f"{k} {v}" for k, v in _RUN.items())
_DEALT = "shard int, part int, kind int, at int, rid long, words binary"


def _window_anchors(g: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The smallest phrase hash of each window, by doubling."""
    span = window - anchor + 1
    m, width = g, 1
    parts, at = None, 0
    while span:
        if span & 1:
            shifted = m[at:]
            parts = shifted if parts is None else np.minimum(parts[: len(shifted)], shifted[: len(parts)])
            at += width
        span >>= 1
        if span:
            m, width = np.minimum(m[:-width], m[width:]), 2 * width
    return parts[: len(g) - (window - anchor)]


def _list_array(rows: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def _first_pass(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, anchors = [], [], []
            for s in slices(batch.column(2)):
                raw = s.data.tobytes()
                for i in range(len(s.first) - 1):
                    h = s.hash[s.first[i] : s.first[i + 1]]
                    n.append(len(h))
                    sha.append(hashlib.sha256(b" ".join(raw[s.text[i] : s.text[i + 1]].split())).hexdigest())
                    if len(h) < window:
                        anchors.append(np.zeros(0, np.int64))
                        continue
                    g = grams(h, anchor)
                    a = np.unique(_window_anchors(g, window, anchor))
                    g = np.sort(g)
                    twice = a[np.searchsorted(g, a, "right") - np.searchsorted(g, a) > 1]
                    anchors.append(np.concatenate((a, twice)).view(np.int64))  # phrases that recur here are listed twice
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), _list_array(anchors, pa.int64())], ["doc_id", "key", "n_words", "sha", "anchors"])

    return run


def _deal(parts: np.ndarray, window: int, anchor: int):
    """Rows of the automata: phrases (kind 0) for their shard, and the chunks of each text (kind 1) for its shards.

    A phrase is written out by the text that it is first seen in, once for each part of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = batch.column(2)
            value, own, shard = (phrases.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            offs, rid = phrases.offsets.to_numpy(), batch.column(0).to_numpy()
            for s in slices(batch.column(1)):
                raw = s.data.tobytes()
                for i in range(len(s.first) - 1):
                    x = slice(offs[s.at + i], offs[s.at + i + 1])
                    lo, hi = s.first[i], s.first[i + 1]
                    out: list[tuple[int, int, int, int, bytes]] = []
                    if own[x].any():
                        g = grams(s.hash[lo:hi], anchor)
                        order = np.argsort(g, kind="stable")
                        mine = np.flatnonzero(own[x]) + x.start
                        at = order[np.searchsorted(g, value[mine].view(_U), sorter=order)] + lo
                        for m, w in zip(shard[mine].tolist(), at.tolist()):
                            words = b" ".join(raw[s.start[w] : s.end[w + anchor - 1]].split())
                            out += [(m, part, 0, 0, words) for part in range(parts[m])]
                    chunks = range(lo, max(lo + 1, hi - window + 1), CHUNK)
                    spread = mix((rid[s.at + i] + (np.arange(len(chunks)) << 40)).view(_U))
                    for at, part in zip(chunks, spread.tolist()):
                        words = b" ".join(raw[s.start[at] : s.end[min(hi, at + CHUNK + window - 1) - 1]].split())
                        out += [(m, part % int(parts[m]), 1, at - lo, words) for m in np.unique(shard[x]).tolist()]
                    if out:
                        m, part, kind, at, words = zip(*out)
                        ints = [pa.array(c, pa.int32()) for c in (m, part, kind, at)]
                        yield pa.RecordBatch.from_arrays([*ints, pa.array(np.full(len(out), rid[s.at + i])), pa.array(words, pa.binary())], ["shard", "part", "kind", "at", "rid", "words"])

    return run


class PhraseAutomaton:
    """An Aho-Corasick automaton of phrases of ``anchor`` words. A letter stands for all words of one hash modulo LETTERS.

    The automaton looks a letter up by trying a node's branches one by one, so few letters make it fast; that two phrases
    may be spelt alike is made good by comparing the hash of what was located with those of the phrases."""

    def __init__(self, phrases: list[bytes], anchor: int):
        self.anchor = anchor
        h = [s.hash for s in slices(pa.array(phrases, pa.binary()))]
        h = np.concatenate(h) if h else np.zeros(0, _U)
        self.phrases = np.sort(grams(h, anchor)[::anchor])
        text = self._text(h)
        self.automaton = ahocorasick.Automaton()
        for i in range(0, len(h), anchor):
            self.automaton.add_word(text[i : i + anchor], anchor)
        if len(h):
            self.automaton.make_automaton()

    @staticmethod
    def _text(h: np.ndarray) -> str:
        return ((h >> _U(9)) % _U(LETTERS) + _U(48)).astype(np.uint8).tobytes().decode("latin-1")

    def located(self, h: np.ndarray) -> np.ndarray:
        """Where phrases start in a text with the word hashes ``h``."""
        if not len(self.phrases) or len(h) < self.anchor:
            return np.zeros(0, np.int64)
        at = np.fromiter((e for e, _ in self.automaton.iter(self._text(h))), np.int64) - (self.anchor - 1)
        found = grams(h, self.anchor)[at]
        return at[self.phrases[np.minimum(np.searchsorted(self.phrases, found), len(self.phrases) - 1)] == found]


def _digests(s: Slice, other: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Both word hashes of a text with their powers' sums, from which hashes of any range of words come."""
    for h in (s.hash[lo:hi], other[lo:hi]):
        p, inv = _powers(len(h) + 1)
        yield h, np.concatenate((np.zeros(1, _U), np.cumsum(h * p[: len(h)]))), inv


def _runs(s: Slice, automaton: PhraseAutomaton, rid: np.ndarray, at: np.ndarray, window: int, anchor: int) -> pa.RecordBatch | None:
    """Runs of neighbouring windows with one located anchor, with 128-bit digests of the run and of each window."""
    rows: dict[str, list] = {k: [] for k in ("rid", "anchor", "start", "size", "whole", "whole2")}
    windows: tuple[list, list] = ([], [])
    other = None
    for i in range(len(s.first) - 1):
        lo, hi = s.first[i], s.first[i + 1]
        found = automaton.located(s.hash[lo:hi])
        if not len(found) or hi - lo < window:
            continue
        g = grams(s.hash[lo:hi], anchor)
        mine = np.full(len(g), _U(2**64 - 1))
        mine[found] = g[found]
        a = _window_anchors(g, window, anchor)
        ok = np.flatnonzero(_window_anchors(mine, window, anchor) == a)  # the least phrase of the window is located
        if not len(ok):
            continue
        cut = np.flatnonzero((np.diff(ok) > 1) | (a[ok[1:]] != a[ok[:-1]])) + 1
        begin, end = ok[np.concatenate(([0], cut))], ok[np.concatenate((cut - 1, [len(ok) - 1]))] + 1
        size = end - begin
        other = s.second(s.start, s.end) if other is None else other
        for k, (h, total, inv) in enumerate(_digests(s, other, lo, hi)):
            rows[("whole", "whole2")[k]].append(mix((total[end + window - 1] - total[begin]) * inv[begin] ^ (size.astype(_U) * _U(0xD6E8FEB86659FD93))))
            each = grams(h, window).view(np.int64)
            windows[k].extend(each[x:y] for x, y in zip(begin, end))
        rows["rid"].append(np.full(len(begin), rid[s.at + i]))
        rows["anchor"].append(a[begin])
        rows["start"].append(begin + at[s.at + i])
        rows["size"].append(size)
    if not windows[0]:
        return None
    c = {k: np.concatenate(v) for k, v in rows.items()}
    longs = {k: pa.array(c[k].view(np.int64)) for k in ("rid", "anchor", "whole", "whole2")}
    ints = {k: pa.array(c[k].astype(np.int32)) for k in ("start", "size")}
    lists = {k: _list_array(w, pa.int64()) for k, w in zip(("windows", "windows2"), windows)}
    columns = longs | ints | lists
    return pa.RecordBatch.from_arrays([columns[k] for k in _RUN], list(_RUN))


def _locate(window: int, anchor: int):
    """Compiles each shard's automaton from its phrases, which come first, and streams its chunks through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, phrases, automaton = None, [], None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)] if len(key) else []
            for x, y in zip(cuts, cuts[1:]):
                if last is None or (key[x, :2] != last).any():
                    last, phrases, automaton = key[x, :2], [], None
                words = batch.column(5).slice(x, y - x)
                if key[x, 2] == 0:
                    phrases += words.to_pylist()
                    continue
                if automaton is None:
                    automaton, phrases = PhraseAutomaton(phrases, anchor), []
                at, rid = batch.column(3).to_numpy()[x:y], batch.column(4).to_numpy()[x:y]
                for s in slices(words):
                    out = _runs(s, automaton, rid, at, window, anchor)
                    if out is not None:
                        yield out

    return run


def _kept_words(text: str, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[list[bytes], np.ndarray]:
    """The words of ``text`` and whether each stays, if windows start from each begin up to before its end."""
    words = text.encode().split()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end + (window - 1), -1)
    return words, np.cumsum(edge[:-1]) == 0


def _drop_pass(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(2)
            begin, end = (runs.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            offs = runs.offsets.to_numpy()
            removed, kept = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words, keep = _kept_words(text, begin[offs[i] : offs[i + 1]], end[offs[i] : offs[i + 1]], window)
                removed.append(len(words) - int(keep.sum()))
                kept.append(hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(keep)])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["rid", "removed", "kept"])

    return run


def _texts_of(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` (rid, key, doc_id, ...) with the texts; copies of a text go to as many places as they have doc_ids."""
    near = keyed.join(checked_broadcast(table.select("key").distinct()), "key", "left_semi")
    t = table.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    return near.join(t, F.expr("key = _k and doc_id <=> _d")).drop("_d", "_k", "doc_id", "key").dropDuplicates(["rid"])


def _recurring(docs: DataFrame, window: int, anchor: int, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(each row's first pass with rid and copies, the runs of recurring windows by rid, the texts by key)."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    first = keyed.select("doc_id", "key", "text").mapInArrow(tidy(_first_pass(window, anchor)), _FIRST)
    first = durable(first.withColumn("rid", F.monotonically_increasing_id()), "first")  # numbered once, as written
    copies = durable(first.groupBy("key").agg(F.count("*").alias("copies"), F.min("rid").alias("head")), "copies")
    heads = first.where(f"n_words >= {window}").join(checked_broadcast(copies.select(F.col("head").alias("rid"))), "rid", "left_semi")
    listed = heads.select("rid", "n_words", F.explode("anchors").alias("a"))
    # Confirmed phrases: those that stand in two places. The first text that has one writes it out.
    again = listed.groupBy("a").agg(F.count("*").alias("n"), F.min(F.struct("rid", "n_words")).alias("home")).where("n > 1")
    again = durable(again.selectExpr("a", "home.rid home", f"xxhash64(home.rid, pmod(a, 1 + home.n_words div {SPREAD})) deal"), "again")
    shards = max(1, -(-again.count() // shard))
    # Which shards each document is streamed through; the join is between exchanges of two tables, so hot phrases split.
    held = listed.join(again, "a").groupBy("rid").agg(F.collect_set(F.struct("a", F.expr("home = rid").alias("own"), F.expr(f"cast(pmod(deal, {shards}) as int)").alias("shard"))).alias("phrases"))
    held = durable(held.join(first.select("rid", "key", "doc_id", "n_words"), "rid"), "held")
    load = held.select(F.explode(F.array_distinct("phrases.shard")).alias("shard"), "n_words").groupBy("shard").agg(F.sum("n_words").alias("n"))
    parts = np.ones(shards, np.int64)  # of each shard, by the words that it sees; one number for SHARD phrases
    for r in load.collect():
        parts[r["shard"]] = -(-r["n"] // PART)
    dealt = _texts_of(keyed, held.drop("n_words")).select("rid", "text", "phrases").mapInArrow(tidy(_deal(parts, window, anchor)), _DEALT)
    dealt = dealt.repartition(2 * int(parts.sum()), "shard", "part").sortWithinPartitions("shard", "part", "kind")
    runs = durable(dealt.mapInArrow(tidy(_locate(window, anchor)), _RUNS), "runs")
    for t in (again, held):
        discard(t)
    lone = runs.groupBy("whole", "whole2").agg(F.count("*").alias("n"), F.min("anchor").alias("anchor")).where("n = 1").select("anchor")
    lone = durable(lone.distinct(), "lone")
    loose = durable(runs.join(lone, "anchor").select("rid", "start", F.posexplode(F.arrays_zip("windows", "windows2")).alias("k", "h")).select("rid", "start", "k", "h.windows", "h.windows2"), "loose")
    twice = durable(loose.groupBy("windows", "windows2").agg(F.count("*").alias("n")).where("n > 1").select("windows", "windows2"), "twice")
    one = loose.join(twice, ["windows", "windows2"]).select("rid", (F.col("start") + F.col("k")).alias("b"), (F.col("start") + F.col("k") + 1).alias("e"))
    full = runs.join(lone, "anchor", "left_anti").selectExpr("rid", "start b", "start + size e")
    spans = durable(full.union(one).groupBy("rid").agg(F.collect_list(F.struct("b", "e")).alias("spans")), "spans")
    for t in (runs, lone, loose, twice):
        discard(t)
    return first.drop("anchors").join(copies, "key"), spans, keyed


def _gone(window: int):
    return F.expr(f"copies > 1 and n_words >= {window}")


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text, ...).

    A word goes if a window that covers it also starts anywhere else; windows are judged on the input. The SHA-256 is
    of the kept words, joined by one space. Null texts have no words. Equal texts of a window or more vanish in all
    their copies, the first included; shorter texts stay. An empty table gives no rows."""
    rows, spans, keyed = _recurring(docs, window, anchor, shard)
    cut = durable(rows.where("copies = 1").select("rid", "key", "doc_id").join(spans, "rid"), "cut")
    cut = durable(_texts_of(keyed, cut).select("rid", "text", "spans").mapInArrow(tidy(_drop_pass(window)), "rid long, removed long, kept string"), "kept")
    return rows.join(cut, "rid", "left").select(
        "doc_id", "n_words",
        F.when(_gone(window), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(_gone(window), _EMPTY).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def strip_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """``docs`` with the words of recurring passages taken out of the column text.

    Texts without such passages stay as they are; of the others the kept words are joined by one space, and n_chars,
    if there is such a column, follows. No row is dropped: a text of recurring passages only becomes empty."""
    rows, spans, _ = _recurring(docs, window, anchor, shard)
    whole = rows.where(_gone(window)).select("key", F.array(F.struct(F.lit(0).alias("b"), (F.col("n_words") - (window - 1)).cast("int").alias("e"))).alias("spans")).dropDuplicates(["key"])
    marks = durable(rows.where("copies = 1").join(spans, "rid").select("key", "spans").union(whole).withColumnsRenamed({"key": "_qg_key", "spans": "_qg_spans"}), "marks")
    small = marks.agg(F.sum(F.size("_qg_spans"))).first()[0] or 0
    marked = docs.withColumn("_qg_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    marked = marked.join(F.broadcast(marks) if small <= BROADCAST_ROWS else marks, "_qg_key", "left").drop("_qg_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at, spans = names.index("text"), batch.column(names.index("_qg_spans"))
            text = batch.column(at).to_pylist()
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                part = spans[int(i)].values
                words, keep = _kept_words(text[i], part.field(0).to_numpy(), part.field(1).to_numpy(), window)
                text[i] = b" ".join([words[k] for k in np.flatnonzero(keep)]).decode()
            columns = [pa.array(text, batch.schema.field(at).type) if n == "text" else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = marked.mapInArrow(tidy(run), marked.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_qg_spans").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
