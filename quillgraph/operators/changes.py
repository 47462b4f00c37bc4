"""The change log of stores and deletes: (seq, sub_seq, event, id), in the order in which listeners hear them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The events, and their order within one store.
EVENTS = ("node:created", "node:updated", "node:deleted", "edge:created", "edge:deleted", "link:auto", "eviction")


def of_stores(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Events of storing ``nodes`` (seq) with their auto-links (source_seq): links first, if there are any."""
    linked = links.select(F.col("source_seq").alias("seq")).distinct().select("seq", F.lit(0).alias("sub_seq"), F.lit("link:auto").alias("event"), F.col("seq").alias("id"))
    return linked.union(nodes.select("seq", F.lit(1), F.lit("node:created"), "seq"))


def of_evictions(victims: DataFrame, at: int) -> DataFrame:
    """Events of evicting ``victims`` (seq) when node ``at`` was stored: a delete, then the eviction, for each."""
    return victims.select("seq", F.posexplode(F.array(F.lit("node:deleted"), F.lit("eviction"))).alias("k", "event")).select(F.lit(at).cast("long").alias("seq"), (F.col("k") + 2).alias("sub_seq"), "event", F.col("seq").alias("id"))
