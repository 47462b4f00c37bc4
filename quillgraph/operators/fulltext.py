"""Full-text search over content and summary: a query grammar and BM25 ranks.

A query becomes an expression over the places of its words in a row: how often each phrase stands in it, and whether the
row matches. The places come from the token arrays of the rows, or from the postings of a :mod:`textindex`. One aggregate
gives the number of rows, the mean length and each phrase's rows; the rank is then computed row by row.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.search import SearchFilter, page, predicate

K1, B, LEAST_IDF, NEAR = 1.2, 0.75, 1e-6, 10
BOTH = ("content", "summary")


def _folded() -> dict[str, str]:
    """Latin letters with one mark, each with what it is without; those with two stay, as do those of other scripts."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)
        if len(base) == 2 and base[0].isascii() and base[0].isalpha():
            out[c] = base[0]
    return out


_FOLDED = _folded()
_FROM, _TO = "".join(_FOLDED), "".join(_FOLDED.values())


class QueryError(ValueError):
    """The query does not follow the grammar."""


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without accents, be these part of their letter or marks of their own."""
    plain = F.regexp_replace(F.translate(text, _FROM, _TO), r"(?<=\p{L})\p{Mn}+", "")
    return F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}]+"), 0)


def indexed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the columns _content and _summary: what a query is evaluated on."""
    return nodes.withColumns({"_content": tokens(F.coalesce("content", F.lit(""))), "_summary": tokens(F.coalesce("summary", F.lit("")))})


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = BOTH

    def starts(self, name: str) -> Column:
        """Positions, from 0, where the phrase starts in a column."""
        k = len(self.words)
        none = F.array().cast("array<int>")

        def found(t: Column) -> Column:
            def here(i: Column) -> Column:
                out = F.lit(True)
                for j, w in enumerate(self.words):
                    x = F.get(t, i + j)
                    out &= x.startswith(w) if self.prefix and j == k - 1 else x == w
                return out

            places = F.filter(F.sequence(F.lit(0), F.lit(0) if self.first else F.size(t) - k), here)
            able = F.size(t) >= k
            return F.when(able if self.prefix and k == 1 else able & F.array_contains(t, self.words[0]), places).otherwise(none)

        # The tokens are bound to a lambda's variable, or the optimizer would put their making into the inner loop.
        return F.get(F.transform(F.array(f"_{name}"), found), 0)


def _total(columns: list[Column]) -> Column:
    return sum(columns, F.lit(0))


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    pattern = re.compile(r'\s+|"((?:[^"]|"")*)"|(\^)|([(){}:*+,-])|([^\W]+)', re.UNICODE)
    while at < len(query):
        m = pattern.match(query, at)
        if not m:
            raise QueryError(f"syntax error near {query[at : at + 10]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("string", m[1].replace('""', '"')))
        elif m[2] or m[3]:
            out.append((m[2] or m[3], m[0]))
        elif m[4]:
            out.append((m[4] if m[4] in ("AND", "OR", "NOT") else "word", m[4]))
    return out


class Parsed:
    """A query as a match condition and its ranked leaves: (count in a matching row, count of the phrase alone).

    ``locate`` gives the places where a phrase starts in a column of a row. A column filter holds for what it stands
    before, in parentheses too; of filters within filters the common columns are left."""

    def __init__(self, query: str, locate: Callable[[Phrase, str], Column] = Phrase.starts):
        self.items, self.at, self.leaves, self.locate = _lex(query), 0, [], locate
        self.starts: dict[str, Column] = {}  # columns that a row needs: where each phrase starts
        if not self.items:
            raise QueryError("empty query")
        self.match = self._or(BOTH)
        if self.at < len(self.items):
            raise QueryError(f"syntax error near {self.items[self.at][1]!r}")

    def _peek(self, ahead: int = 0) -> str:
        return self.items[self.at + ahead][0] if self.at + ahead < len(self.items) else ""

    def _take(self, kind: str) -> str:
        if self._peek() != kind:
            raise QueryError(f"expected {kind}")
        self.at += 1
        return self.items[self.at - 1][1]

    def _or(self, columns: tuple[str, ...]) -> Column:
        out = self._and(columns)
        while self._peek() == "OR":
            self.at += 1
            out = out | self._and(columns)
        return out

    def _and(self, columns: tuple[str, ...]) -> Column:
        out = self._not(columns)
        while self._peek() == "AND":
            self.at += 1
            out = out & self._not(columns)
        return out

    def _not(self, columns: tuple[str, ...]) -> Column:
        out = self._implicit(columns)
        while self._peek() == "NOT":
            self.at += 1
            out = out & ~self._implicit(columns)
        return out

    def _implicit(self, columns: tuple[str, ...]) -> Column:
        out = self._atom(columns)
        while self._peek() in ("word", "string", "^", "(", "{", "-"):
            out = out & self._atom(columns)
        return out

    def _filter(self) -> tuple[str, ...] | None:
        """The columns of a filter that starts here: a name, names in braces, or all but these behind a minus sign."""
        at, but = self.at, self._peek() == "-"
        self.at += but
        if self._peek() == "{":
            self.at += 1
            names = []
            while self._peek() in ("word", "string"):
                names.append(self._take(self._peek()).lower())
            self._take("}")
        elif self._peek() in ("word", "string") and self._peek(1) == ":":
            names = [self._take(self._peek()).lower()]
        elif but:
            raise QueryError("expected a column")
        else:
            self.at = at
            return None
        self._take(":")
        for name in names:
            if name not in BOTH:
                raise QueryError(f"no such column: {name}")
        return tuple(c for c in BOTH if (c in names) != but)

    def _atom(self, columns: tuple[str, ...]) -> Column:
        names = self._filter()
        if names is not None:
            return self._atom(tuple(c for c in columns if c in names))
        if self._peek() == "(":
            self.at += 1
            out = self._or(columns)
            self._take(")")
            return out
        if self._peek() == "word" and self.items[self.at][1] == "NEAR" and self._peek(1) == "(":
            self.at += 2
            phrases, gap = [self._phrase(columns)], NEAR
            while self._peek() in ("word", "string", "^"):
                phrases.append(self._phrase(columns))
            if self._peek() == ",":
                self.at += 1
                gap = int(self._take("word"))
            self._take(")")
            return self._leaf(phrases[0]) if len(phrases) == 1 else self._near(phrases, gap)
        return self._leaf(self._phrase(columns))

    def _places(self, p: Phrase) -> dict[str, Column]:
        """The columns with the phrase's starts, by indexed column."""
        out = {}
        for c in p.columns:
            name = f"_p{len(self.starts)}"
            self.starts[name] = self.locate(p, c)
            out[c] = F.col(name)
        return out

    def _leaf(self, p: Phrase) -> Column:
        if not p.columns:  # filters without a common column
            return F.lit(False)
        n = _total([F.size(x) for x in self._places(p).values()])
        self.leaves.append((n, n))
        return n > 0

    def _near(self, phrases: list[Phrase], gap: int) -> Column:
        """Phrases that stand, in one column, with at most ``gap`` tokens between each two of them."""
        if not phrases[0].columns:
            return F.lit(False)
        places = [self._places(p) for p in phrases]

        def within(i: Column, k: int, j: int, c: str) -> Column:
            a, b = len(phrases[k].words), len(phrases[j].words)
            return F.exists(places[j][c], lambda x: (x - i - a <= gap) & (i - x - b <= gap))

        def kept(k: int, c: str) -> Column:
            others = [j for j in range(len(phrases)) if j != k]
            return F.filter(places[k][c], lambda i: functools.reduce(lambda u, v: u & v, [within(i, k, j, c) for j in others]))

        counts = [_total([F.size(kept(k, c)) for c in p.columns]) for k, p in enumerate(phrases)]
        self.leaves += [(n, _total([F.size(x) for x in place.values()])) for n, place in zip(counts, places)]
        return functools.reduce(lambda a, b: a & b, [n > 0 for n in counts])

    def _phrase(self, columns: tuple[str, ...]) -> Phrase:
        first = self._peek() == "^"
        self.at += first
        if self._peek() not in ("word", "string"):
            raise QueryError("expected a phrase")
        words: list[str] = []
        while True:
            text = self.items[self.at][1]
            self.at += 1
            words += re.findall(r"[^\W_]+", text.translate(str.maketrans(_FROM, _TO)).lower())
            if self._peek() != "+":
                break
            self.at += 1
        prefix = self._peek() == "*"
        self.at += prefix
        if not words:
            raise QueryError("a phrase without letters or digits")
        return Phrase(tuple(words), prefix, first, columns)


def plain(text: str) -> str:
    """Any text as a query: its words, each quoted, all of them asked for."""
    return " ".join(f'"{w}"' for w in re.findall(r"[^\W_]+", text))


def ranked(nodes: DataFrame, query: str) -> DataFrame:
    """Matching rows of ``nodes`` (content, summary, ...) with their score: BM25 negated, so the best is the least."""
    q = Parsed(query)
    rows = indexed(nodes).withColumns(q.starts).withColumn("_size", F.size("_content") + F.size("_summary"))
    total = rows.agg(F.count("*").alias("n"), F.sum("_size").alias("len")).first()
    return scored(rows, q, total["n"], total["len"] or 0).drop("_content", "_summary")


def scored(rows: DataFrame, q: Parsed, n: int, length: int) -> DataFrame:
    """The ``rows`` (_size, the starts of ``q``, ...) that match, with their score among ``n`` rows of ``length`` tokens."""
    seen = rows.agg(F.count("*"), *(F.sum((alone > 0).cast("long")).alias(f"df{i}") for i, (_, alone) in enumerate(q.leaves))).first()
    mean = length / max(n, 1)
    rows = rows.where(q.match).withColumns({f"_tf{i}": tf.cast("double") for i, (tf, _) in enumerate(q.leaves)})
    score = F.lit(0.0)
    for i in range(len(q.leaves)):
        df = F.lit(float(seen[f"df{i}"] or 0))
        idf = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5))
        tf = F.col(f"_tf{i}")
        score = score + F.when(idf <= 0, LEAST_IDF).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_size") / F.lit(mean or 1.0)))
    return rows.withColumn("score", -score).drop("_size", *q.starts, *(f"_tf{i}" for i in range(len(q.leaves))))


def search(nodes: DataFrame, f: SearchFilter, observed: bool = False) -> DataFrame:
    """The page of matches by score, ties by seq. ``observed``: only query, limit and offset count."""
    found = ranked(nodes, f.query)
    if not observed:
        found = found.where(predicate(f))
    return page(found, [F.col("score").asc(), F.col("seq").asc()], f.limit, f.offset)
