"""Node and edge tables, and the node table over the driver's fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "seq long, id string, content string, summary string, type string, metadata string, importance double, created_at long, updated_at long, last_accessed long, access_count long"
EDGES = "id string, source_id string, target_id string, relation string, weight double, metadata string, created_at long"
# Kinds of nodes and of edges, and what a row gets where nothing is given.
TYPES = ("fact", "preference", "context", "relationship", "entity", "custom")
RELATIONS = ("relates_to", "contradicts", "supports", "derived_from", "part_of", "custom")
DEFAULT_IMPORTANCE, DEFAULT_WEIGHT, DEFAULT_THRESHOLD = 0.5, 0.5, 0.3
EPOCH = 1704067200000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> F.Column:
    """Unix milliseconds of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def iso(column: str) -> F.Column:
    """ISO 8601 in UTC, with milliseconds, of Unix milliseconds."""
    return F.date_format(F.expr(f"timestampadd(MILLISECOND, {column}, timestamp_ntz'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fixture_nodes(spark: SparkSession, sf_dir: str, width: int | None = None) -> DataFrame:
    """The node table over ``documents``: importance from labels, access statistics from the view events.

    Contents are cut to ``width`` characters before the joins, so whole texts are not shuffled for their beginnings."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    if width is not None:
        docs = docs.withColumn("text", F.substring("text", 1, width))
    views = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("access_count"), F.max(millis("ts")).alias("seen"))
    rows = docs.join(labels, "doc_id", "left").join(views, docs.doc_id == views.user_id, "left")
    created = F.lit(EPOCH) + docs.doc_id * 1000
    return rows.select(
        docs.doc_id.alias("seq"), docs.doc_id.cast("string").alias("id"), F.col("text").alias("content"),
        F.get(F.array(*map(F.lit, TYPES)), F.pmod(docs.doc_id, F.lit(len(TYPES))).cast("int")).alias("type"),
        F.to_json(F.struct("lang", "source", "n_chars")).alias("metadata"),
        F.when(F.col("quality").isNull(), 0.5).when(F.col("toxic") == 1, 0.1).when(F.col("quality") == 1, 0.9).otherwise(0.3).alias("importance"),
        created.alias("created_at"), created.alias("updated_at"),
        F.greatest(created, "seen").alias("last_accessed"), F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
    )
