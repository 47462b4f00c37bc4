"""Connected components of an undirected edge table by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.durable import discard, durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u > v): hang neighbours on the smallest of the neighbourhood.

    The minimum per node is summed map-side, written, and joined back from its table: both inputs of the join are
    plain exchanges, so adaptive execution can split the partition of a hub."""
    sides = edges.select("u", "v")
    if large:
        sides = sides.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = durable(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    done = durable(out.where("u <> v").distinct(), "star")
    discard(least)
    return done


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for each node of ``edges``; component is the smallest id reachable.

    Direction is ignored, self-loops only name their node, null ends are dropped, repeated edges count once. Nodes
    without edges are not in the result: join it to the node table from the left."""
    clean = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    current = durable(clean.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    loops = clean.where(F.col(src) == F.col(dst)).select(F.col(src).alias("u"))
    seen = None
    for _ in range(max_rounds):
        big = _star(current, True)
        discard(current)
        current = _star(big, False)
        discard(big)
        # Stars are stable when a round leaves the same edge set: compare its size and an order-free checksum.
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component"))
    lone = loops.select(F.col("u").alias("id"), F.col("u").alias("component"))
    return stars.union(roots).union(lone).groupBy("id").agg(F.min("component").alias("component"))
