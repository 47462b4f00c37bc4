"""Changes of state, each a function from tables to tables: links, updates, deletes, accesses, eviction, the ops log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.durable import checked_broadcast
from quillgraph.plans.paging import page


class NotFound(KeyError):
    """A node that an operation needs does not exist."""


def forget(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``ids`` (id) and the edges at them."""
    gone = checked_broadcast(ids.select("id").distinct())
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti").select(nodes.columns), left.select(edges.columns)


def drop_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("id").distinct(), "id", "left_anti").select(edges.columns)


def valid_links(nodes: DataFrame, edges: DataFrame, new: DataFrame, strict: bool = True) -> DataFrame:
    """The rows of ``new`` that may be added: both ends exist, and (source_id, target_id, relation) is new.

    ``strict`` raises instead if any row would be lost, and leaves the state as it is. Self-loops are allowed."""
    ids = nodes.select("id")
    ends = new.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    key = ["source_id", "target_id", "relation"]
    fresh = ends.dropDuplicates(key).join(edges.select(key), key, "left_anti").select(new.columns)
    if strict:
        total, ended, added = new.count(), ends.count(), fresh.count()
        if ended < total:
            raise NotFound("Node not found")
        if added < ended:
            raise ValueError("an edge with this source, target and relation exists")
    return fresh


def merge_updates(nodes: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """``nodes`` with the non-null fields of ``updates`` (id, and any of content, summary, type, metadata, importance).

    Metadata is replaced whole. An update counts as an access; summary and links are not made anew."""
    fields = [c for c in updates.columns if c != "id"]
    u = updates.select("id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in fields))
    out = nodes.join(u, "id", "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields})
    hit = F.coalesce("_hit", F.lit(False))
    out = out.withColumns({
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
        "last_accessed": F.when(hit, F.lit(now)).otherwise(F.col("last_accessed")),
        "access_count": F.col("access_count") + hit.cast("long"),
    })
    return out.select(nodes.columns)


def access_stats(accesses: DataFrame) -> DataFrame:
    """(id, accesses, last_access) of an access log (id, ts)."""
    return accesses.groupBy("id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))


def fold_accesses(nodes: DataFrame, accesses: DataFrame) -> DataFrame:
    """``nodes`` with the log's accesses added to their statistics."""
    out = nodes.join(access_stats(accesses), "id", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("accesses", F.lit(0)), "last_accessed": F.greatest("last_accessed", "last_access")}).select(nodes.columns)


def evict(nodes: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` nodes that eviction leaves: it takes the least important, then the longest unread, then the oldest.

    A limit of 0 is none. As the order is total, one page of it equals evicting after each insert."""
    return page(nodes, [F.desc("importance"), F.desc("last_accessed"), F.desc("seq")], limit) if limit > 0 else nodes


def victims(nodes: DataFrame, limit: int) -> DataFrame:
    """The nodes that go, in the order of their going."""
    return nodes.join(evict(nodes, limit).select("seq"), "seq", "left_anti").select(nodes.columns).orderBy("importance", "last_accessed", "seq")


def latest(ops: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last op of each key: what an append-only log folds to."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return ops.withColumn("_r", rank).where("_r = 1").drop("_r")
