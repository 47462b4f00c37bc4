"""Tokens and binary cosine similarity as built-in expressions, extractive summaries row by row."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

# The words that similarity ignores. Summaries ignore the shorter list below.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could to of in "
    "for on with at by from as into through during before after above below between and but or nor not so yet both either "
    "neither each every all any few more most other some such no only own same than too very just because about up out it its "
    "this that these those i me my we our you your he him his she her they them their"
).split()
SUMMARY_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could to of in "
    "for on with at by from as into through and but or not it its this that"
).split()
#: Sentences of up to this many characters are left out of a summary; a text without others gives its beginning.
SHORT, HEAD = 10, 120


def clean_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits; other characters vanish, so a word may be empty."""
    return F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+")


def bag(text: Column) -> Column:
    """Distinct words of two characters or more that aren't stop words."""
    words = F.filter(F.array_distinct(clean_words(text)), lambda w: F.length(w) > 1)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


_GONE = bytes(set(range(256)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789 \t\n\x0b\f\r"))
_IGNORED = frozenset(w.encode() for w in (*STOP_WORDS, *"abcdefghijklmnopqrstuvwxyz0123456789"))


def hashed_words(lowered: Iterable[str]) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of the words of the :func:`bag` of each text, one after the other, and how many each has."""
    bags = [set(t.encode("ascii", "ignore").translate(None, _GONE).split()) - _IGNORED for t in lowered]
    flat = np.empty(sum(map(len, bags)), object)
    flat[:] = [w for b in bags for w in b]
    return pd.util.hash_array(flat, categorize=False).view(np.int64), [len(b) for b in bags]


@F.pandas_udf(ArrayType(LongType()))
def _hashes(lowered: pd.Series) -> pd.Series:
    hashed, counts = hashed_words(lowered)
    return pd.Series(np.split(hashed, np.cumsum(counts)[:-1]), dtype=object)


def hashed_bag(text: Column) -> Column:
    """64-bit hashes of the words of :func:`bag`, in any order; of null none. Many times faster than the expression."""
    return _hashes(F.lower(F.coalesce(text, F.lit(""))))


def bag_similarity(a: Column, b: Column) -> Column:
    """|a and b| / sqrt(|a| |b|) of two bags; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("long") * F.size(b))).otherwise(0.0)


def text_similarity(a: Column, b: Column) -> Column:
    return bag_similarity(bag(a), bag(b))


def sentences(text: Column) -> Column:
    """Trimmed sentences of more than SHORT characters."""
    parts = F.split(F.regexp_replace(text, "\n+", " "), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, F.trim), lambda s: F.length(s) > SHORT)


_LINES, _ENDS, _BLANK = re.compile("\n+"), re.compile(r"(?<=[.!?])\s+", re.ASCII), re.compile(r"\s+", re.ASCII)
_NOT_WORD = re.compile(r"[^a-z0-9\s]", re.ASCII)
_FREQUENT = frozenset(SUMMARY_STOP_WORDS)


def summary_of(text: str) -> str:
    """The sentence whose words are the most frequent in the text, on average; the first of equals.

    Without a sentence the first HEAD characters, of a single one the sentence itself."""
    some = [s for s in (x.strip(" ") for x in _ENDS.split(_LINES.sub(" ", text))) if len(s) > SHORT]
    if len(some) < 2:
        return some[0] if some else text[:HEAD]
    words = [_BLANK.split(_NOT_WORD.sub("", s.lower())) for s in some]
    count = Counter(w for row in words for w in row)
    for w in count.keys():
        if len(w) < 2 or w in _FREQUENT:
            count[w] = 0
    return max(zip(some, words), key=lambda x: sum(map(count.__getitem__, x[1])) / len(x[1]))[0]


@F.pandas_udf(StringType())
def extractive_summary(texts: pd.Series) -> pd.Series:
    """:func:`summary_of` each text; null stays null. Each row by itself: nothing is shuffled."""
    return texts.map(lambda t: None if t is None else summary_of(t))


def with_summary(df: DataFrame, text: str = "content", out: str = "summary") -> DataFrame:
    """``df`` with the extractive summary of each text."""
    return df.withColumn(out, extractive_summary(text))


def register(spark: SparkSession) -> None:
    """Make ``text_similarity(a, b)``, ``bag_of_words(a)`` and ``extractive_summary(a)`` callable from SQL."""
    spark.udf.register("extractive_summary", extractive_summary)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = r"array_except(filter(array_distinct(split(regexp_replace(lower({0}), '[^a-z0-9\\s]', ''), '\\s+')), w -> length(w) > 1), array({1}))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bag_of_words(a STRING) RETURNS ARRAY<STRING> RETURN {words.format('a', stops)}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION text_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN "
        "CASE WHEN size(bag_of_words(a)) = 0 OR size(bag_of_words(b)) = 0 THEN 0D ELSE size(array_intersect(bag_of_words(a), bag_of_words(b))) / sqrt(size(bag_of_words(a)) * cast(size(bag_of_words(b)) AS BIGINT)) END"
    )
