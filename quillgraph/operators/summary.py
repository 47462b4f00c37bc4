"""The summary of a corpus: the summaries of its nodes, in order of insertion, summarised once more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import SUMMARY_STOP_WORDS, clean_words, sentences

EMPTY = "No memories stored."


def corpus_summary(nodes: DataFrame) -> DataFrame:
    """One row (summary) for ``nodes`` (seq, summary).

    The summaries are joined by ". ", which ends a sentence. So splitting each summary with a mark behind it, but for
    the last, gives the sentences of the joined text, which need never be built."""
    texts = nodes.select("seq", F.concat(F.coalesce("summary", F.lit("")), F.lit(".")).alias("t"))
    parts = texts.select("seq", F.posexplode(sentences(F.col("t"))).alias("i", "s"))
    last = nodes.agg(F.max("seq").alias("last"), F.count("*").alias("n")).first()
    if not last["n"]:
        return nodes.sparkSession.createDataFrame([(EMPTY,)], "summary string")
    # The last summary has no mark after it.
    bare = F.when((F.col("seq") == last["last"]) & (F.col("i") == F.max("i").over(_by_seq())), F.trim(F.regexp_replace("s", r"\.$", ""))).otherwise(F.col("s"))
    parts = parts.withColumn("s", bare).where(F.length("s") > 10)
    if parts.isEmpty():
        head = nodes.orderBy("seq").limit(121).agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("summary", F.lit("")).alias("t")))).alias("a"))
        return head.select(F.substring(F.array_join(F.transform("a", lambda x: x["t"]), ". "), 1, 120).alias("summary"))
    words = parts.select("seq", "i", F.explode(clean_words(F.col("s"))).alias("w"))
    per = words.groupBy("seq", "i", "w").agg(F.count("*").alias("n"))
    freq = per.where((F.length("w") > 1) & ~F.col("w").isin(SUMMARY_STOP_WORDS)).groupBy("w").agg(F.sum("n").alias("f"))
    score = per.join(freq, "w", "left").groupBy("seq", "i").agg((F.sum(F.coalesce("f", F.lit(0)) * F.col("n")) / F.sum("n")).alias("p"))
    best = score.agg(F.max_by(F.struct("seq", "i"), F.struct("p", -F.col("seq"), -F.col("i"))).alias("b")).select("b.*")
    return parts.join(F.broadcast(best), ["seq", "i"]).select(F.col("s").alias("summary"))


def _by_seq():
    from pyspark.sql import Window

    return Window.partitionBy("seq")
