"""A full-text index in Parquet: postings, written once per batch of nodes and read by term.

Each batch is a segment: postings (term, seq, places in content, places in summary, tokens of the row), dealt by ranges of
terms and sorted, so that a query reads the row groups of its terms only, and rows of a frequent term lie in several
files. Removed nodes are tombstones for the segments up to then; an update is a removal and an addition. Number and length
of the rows stand beside the segments. One writer at a time; readers see whole segments.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.fulltext import Parsed, Phrase, indexed, scored
from quillgraph.operators.search import SearchFilter, page, predicate
from quillgraph.plans.durable import checked_broadcast, durable, shared_dir

POSTINGS = "term string, seq long, content array<int>, summary array<int>, size int"
SIZES, GONE = "seq long, size int", "seq long, upto int"


def _postings(nodes: DataFrame) -> DataFrame:
    """(term, seq, content, summary, size) of the nodes (seq, content, summary)."""
    rows = indexed(nodes).select("seq", "_content", "_summary", (F.size("_content") + F.size("_summary")).alias("size"))
    place = lambda which: F.transform(f"_{which}", lambda w, i: F.struct(F.lit(which == "content").alias("c"), w.alias("term"), i.alias("i")))
    each = rows.select("seq", "size", F.inline(F.concat(place("content"), place("summary"))))
    lists = {c: F.array_sort(F.collect_list(F.when(F.col("c") == F.lit(c == "content"), F.col("i")))).alias(c) for c in ("content", "summary")}
    return each.groupBy("term", "seq", "size").agg(*lists.values()).select("term", "seq", "content", "summary", "size")


class TextIndex:
    """The index in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/textindex-{uuid.uuid4().hex}"
        self.segments: list[str] = []
        self.rows = self.length = 0
        self.gone = spark.createDataFrame([], GONE)

    def add(self, nodes: DataFrame) -> TextIndex:
        """Index more ``nodes`` (seq, content, summary, ...)."""
        path = f"{self.root}/segment-{len(self.segments)}"
        _postings(nodes).repartitionByRange("term", "seq").sortWithinPartitions("term", "seq").write.option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
        # Rows without a token have no postings; they count too.
        indexed(nodes).select("seq", (F.size("_content") + F.size("_summary")).alias("size")).write.parquet(f"{path}/sizes")
        self._count(self.spark.read.schema(SIZES).parquet(f"{path}/sizes"), 1)
        self.segments.append(path)
        return self

    def _count(self, sizes: DataFrame, sign: int) -> None:
        n = sizes.agg(F.count("*"), F.sum("size")).first()
        self.rows, self.length = self.rows + sign * n[0], self.length + sign * (n[1] or 0)

    def remove(self, seqs: DataFrame) -> TextIndex:
        """Take the nodes ``seqs`` (seq) out; unknown ones do not matter."""
        seqs = durable(seqs.select("seq").distinct(), "gone")
        live = self._live("sizes", SIZES).join(checked_broadcast(seqs), "seq", "left_semi")
        self._count(live, -1)
        self.gone = durable(self.gone.unionByName(seqs.withColumn("upto", F.lit(len(self.segments)))), "gone")
        return self

    def update(self, nodes: DataFrame) -> TextIndex:
        """Index ``nodes`` (seq, content, summary, ...) anew."""
        return self.remove(nodes.select("seq")).add(nodes)

    def _live(self, table: str, schema: str, where: Column | None = None) -> DataFrame:
        """The rows of all segments that no tombstone holds for."""
        read = self.spark.read.schema(schema)
        parts = [read.parquet(f"{path}/{table}").withColumn("segment", F.lit(i)) for i, path in enumerate(self.segments)]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment int")
        rows = rows if where is None else rows.where(where)
        gone = checked_broadcast(self.gone.groupBy("seq").agg(F.max("upto").alias("upto")))
        return rows.join(gone, "seq", "left").where("upto is null or segment >= upto").drop("segment", "upto")

    def terms(self) -> DataFrame:
        """(term, rows, places) of each term."""
        return self._live("postings", POSTINGS).groupBy("term").agg(F.count("*").alias("rows"), F.sum(F.size("content") + F.size("summary")).alias("places"))

    def ranked(self, query: str) -> DataFrame:
        """(seq, score) of the nodes that match, as :func:`fulltext.ranked` has them."""
        words: dict[tuple[str, bool], str] = {}

        def locate(p: Phrase, column: str) -> Column:
            names = [words.setdefault((w, p.prefix and k == len(p.words) - 1), f"_w{len(words)}") + "_" + column for k, w in enumerate(p.words)]
            here = lambda i: reduce(lambda a, b: a & b, [F.array_contains(names[k], i + k) for k in range(1, len(names))], F.lit(True))
            return F.filter(names[0], lambda i: here(i) & (i == 0) if p.first else here(i))

        q = Parsed(query, locate)
        is_ = {name: F.col("term").startswith(w) if prefix else F.col("term") == w for (w, prefix), name in words.items()}
        if not is_:
            return self.spark.createDataFrame([], "seq long, score double")
        some = self._live("postings", POSTINGS, reduce(lambda a, b: a | b, is_.values()))
        places = [F.array_sort(F.flatten(F.collect_list(F.when(fits, F.col(c))))).alias(f"{name}_{c}") for name, fits in is_.items() for c in ("content", "summary")]
        rows = some.groupBy("seq").agg(F.first("size").alias("_size"), *places)
        drop = [f"{name}_{c}" for name in is_ for c in ("content", "summary")]
        return scored(rows.withColumns(q.starts), q, self.rows, self.length).drop(*drop)

    def search(self, f: SearchFilter, nodes: DataFrame | None = None, observed: bool = False) -> DataFrame:
        """The page of matches by score, ties by seq: (seq, score), or the ``nodes`` with their score.

        Fields of the filter other than the query need ``nodes``; ``observed``: only query, limit and offset count."""
        found, order = self.ranked(f.query), [F.col("score").asc(), F.col("seq").asc()]
        if nodes is None:
            return page(found, order, f.limit, f.offset)
        if not observed:
            return page(nodes.where(predicate(f)).join(found, "seq"), order, f.limit, f.offset)
        top = page(found, order, f.limit, f.offset)
        return nodes.join(top, "seq").orderBy(*order)
