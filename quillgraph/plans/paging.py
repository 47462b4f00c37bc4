"""Pages of an ordered table at any depth. Short ones are a top-k; deep ones never pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.durable import durable

#: Rows up to which limit and offset together are a top-k, which one task merges.
TOP = 100_000


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, top: int = TOP) -> DataFrame:
    """The rows of ``df`` by ``order`` from ``offset`` on, ``limit`` of them or, if that is negative, all.

    The order should be total. Beyond ``top`` rows the table is sorted by ranges and written; a row's rank is its place
    in its range plus the rows of the ranges before, of which the driver holds one number a range."""
    if limit < 0 and not offset:
        return df.orderBy(*order)
    if 0 <= limit and limit + offset <= top:
        return df.orderBy(*order).offset(offset).limit(limit)
    placed = durable(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    rows, before = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["n"]
    ranges = F.broadcast(df.sparkSession.createDataFrame(rows, "_part long, _before long"))
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)
    kept = (rank >= offset) & (rank < offset + limit) if limit >= 0 else rank >= offset
    return placed.join(ranges, part == F.col("_part")).where(kept).orderBy("_place").select(df.columns)
