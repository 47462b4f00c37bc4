"""A corpus pipeline of the operators in quillgraph.llm: toxic documents go, one document of each near-duplicate group
stays, recurring passages are cut out, personal data is masked, and what is left is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.minhash_dedup import drop_near_duplicates
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.pii import redact
from quillgraph.llm.substring_dedup import strip_passages
from quillgraph.llm.toxicity import drop_toxic
from quillgraph.plans.durable import durable

#: Percent of common shingles from which the stage takes texts as near copies; op2_minhash_dedup has its own.
NEAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, percent=NEAR)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return strip_passages(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("packing", packing),
]
#: The stages learn, search and pack: SQL cannot express them. The tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each returns is written as Parquet and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
