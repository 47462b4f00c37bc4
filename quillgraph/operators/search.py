"""Structured search: filters, order and pages over the node table, and filters over the edge table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.paging import page

# The fields to sort by; anything else, relevance included, means updated_at.
SORT_FIELDS = {"importance": "importance", "createdAt": "created_at", "updatedAt": "updated_at", "accessCount": "access_count"}


@dataclass(frozen=True)
class SearchFilter:
    """What to search for. ``limit`` -1 means all; importance bounds are inclusive; metadata compares as text."""

    query: str | None = None
    type: str | None = None
    min_importance: float | None = None
    max_importance: float | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    limit: int = 20
    offset: int = 0
    sort_by: str = "updatedAt"
    sort_order: str = "desc"

    def __post_init__(self):
        if self.sort_order not in ("asc", "desc"):
            raise ValueError(f"sort_order must be asc or desc, not {self.sort_order!r}")


def predicate(f: SearchFilter) -> Column:
    """The conjunction of the filter's conditions; an empty type or no metadata is no condition."""
    out = F.lit(True)
    if f.type:
        out &= F.col("type") == f.type
    if f.min_importance is not None:
        out &= F.col("importance") >= f.min_importance
    if f.max_importance is not None:
        out &= F.col("importance") <= f.max_importance
    for key, value in f.metadata.items():
        out &= F.from_json("metadata", "map<string,string>")[key] == str(value)
    return out


def structured(nodes: DataFrame, f: SearchFilter) -> DataFrame:
    """Nodes that satisfy the filter, each with score 1, in its order; ties by seq."""
    by = F.col(SORT_FIELDS.get(f.sort_by, "updated_at"))
    order = [by.asc() if f.sort_order == "asc" else by.desc(), F.col("seq").asc()]
    return page(nodes.where(predicate(f)), order, f.limit, f.offset).withColumn("score", F.lit(1.0))


def edges(edges: DataFrame, source: str | None = None, target: str | None = None, relation: str | None = None) -> DataFrame:
    """Edges with the given ends and relation; an empty value is no condition."""
    for name, value in (("source_id", source), ("target_id", target), ("relation", relation)):
        if value:
            edges = edges.where(F.col(name) == value)
    return edges
