"""Chat helpers over conversations (conv_id, turn, role, text): what to store, transcripts and prompts with memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least lengths of user messages that are stored, memories recalled, and the texts of prompts.
STORE_FROM, STORE_FROM_CHAIN, RECALL = 20, 15, 5
NO_MEMORIES = "You are a helpful assistant. Answer based on the conversation."
PROMPT = (
    "You are a helpful assistant with access to the user's stored memories.\nUse the following memories to personalize your responses. "
    "Do not mention that you have access to memories unless asked.\n\nRelevant memories:\n%s\n\nAnswer naturally based on both the conversation and your memories."
)
SPEAKERS = {"user": "Human", "assistant": "AI"}


def to_store(turns: DataFrame, least: int = STORE_FROM) -> DataFrame:
    """User messages that are long enough to become memories."""
    return turns.where((F.col("role") == "user") & (F.length("text") >= least))


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): a line for each turn, in order."""
    speaker = F.col("role")
    for role, name in SPEAKERS.items():
        speaker = F.when(F.col("role") == role, name).otherwise(speaker)
    lines = turns.select("conv_id", F.struct("turn", F.concat_ws(": ", speaker, F.coalesce("text", F.lit(""))).alias("line")).alias("x"))
    ordered = F.array_sort(F.collect_list("x"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("transcript"))


def memory_lines(memories: Column, numbered: bool) -> Column:
    """Lines of an array of (type, content): "  1. [type] content" or "[type] content"."""
    if numbered:
        line = lambda m, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". ["), m["type"], F.lit("] "), m["content"])
    else:
        line = lambda m: F.concat(F.lit("["), m["type"], F.lit("] "), m["content"])
    return F.array_join(F.transform(memories, line), "\n")


def system_prompt(memories: DataFrame) -> DataFrame:
    """One row with the prompt for ``memories`` (rank, type, content), which a recall has bounded."""
    found = F.array_sort(F.collect_list(F.struct("rank", "type", "content")))
    lines = memories.agg(found.alias("m")).select(F.size("m").alias("n"), memory_lines(F.col("m"), True).alias("lines"))
    return lines.select(F.when(F.col("n") == 0, NO_MEMORIES).otherwise(F.format_string(PROMPT, "lines")).alias("prompt"))


def chain_context(memories: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(conv_id, history): the recalled memories before each transcript; the transcript alone if there are none."""
    lines = memories.agg(F.array_sort(F.collect_list(F.struct("rank", "type", "content"))).alias("m")).select(F.size("m").alias("n"), memory_lines(F.col("m"), False).alias("lines"))
    text = F.when(F.col("n") == 0, F.col("transcript")).otherwise(F.concat(F.lit("Relevant memories:\n"), "lines", F.lit("\n\n"), "transcript"))
    return transcripts.crossJoin(F.broadcast(lines)).select("conv_id", text.alias("history"))


def of_types(found: DataFrame, types: tuple[str, ...], limit: int) -> DataFrame:
    """The best ``limit`` of ranked memories (score, seq, type, ...) that have one of ``types``; no types: any."""
    some = found.where(F.col("type").isin(*types)) if types else found
    return some.orderBy("score", "seq").limit(limit)
