"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe_replay, media, token_store
from quillgraph.llm.minhash_dedup import near_duplicates
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.pii import KINDS, as_text, count_kind, find_personal_data
from quillgraph.llm.substring_dedup import repeated_passages
from quillgraph.llm.toxicity import toxic_documents
from quillgraph.llm.url_filter import filter_urls
from quillgraph.llm.vector_join import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    made = bpe_replay.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.new_path(spark)
    token_store.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.digests(spark, path)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprint_digests(media.store_media(_table(spark, sf_dir, "documents"), media.new_path(spark)))


def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_bpe_replay": op3_bpe_replay,
    "op4_token_store": op4_token_store,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_media_columns": op8_media_columns,
    "op9_vector_join": op9_vector_join,
    "op10_pii": op10_pii,
}
# Smallest id that links reach, for each id of ``links`` (a, b).
_REACHED = """two AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON t.a = r.b),
least AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""

#: Twins of the queries that SQL can say.
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM each p JOIN each q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
{_REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sets LEFT JOIN least ON id = doc_id""",
    "op6_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n, w FROM w),
windows AS (SELECT doc_id, word, i, CASE WHEN i + 34 <= n THEN array_to_string(w[i:i + 34], ' ') END AS x FROM words),
marked AS (SELECT doc_id, word, i, x IS NOT NULL AND count(*) OVER (PARTITION BY x) > 1 AS again FROM windows),
covered AS (SELECT doc_id, word, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
sums AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN sums USING (doc_id)""",
    "op9_vector_join": rf"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.e) = len(q.e) AND list_dot_product(p.e, q.e) / (p.norm * q.norm) >= 0.98),
{_REACHED},
degree AS (SELECT a AS id, count(*) AS n FROM two GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM v LEFT JOIN least ON least.id = vec_id LEFT JOIN degree ON degree.id = vec_id""",
}
