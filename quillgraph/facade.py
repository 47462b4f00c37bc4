"""MemoryGraph: the operators behind one object. State is a pair of immutable tables; each change makes a new pair."""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import with_summary
from quillgraph.operators import fulltext, graph, lifecycle, linking, search
from quillgraph.operators.changes import EVENTS
from quillgraph.operators.summary import corpus_summary
from quillgraph.plans.durable import discard, durable
from quillgraph.schema import DEFAULT_IMPORTANCE, DEFAULT_THRESHOLD, DEFAULT_WEIGHT, EDGES, NODES
from quillgraph.sources.store import ParquetStore, Snapshot


class MemoryGraph:
    """Config: ``max_memories`` (0: no eviction), ``threshold`` of auto-links (0: none), a store, and a clock in ms."""

    def __init__(self, spark: SparkSession, store: ParquetStore | None = None, max_memories: int = 0, threshold: float = DEFAULT_THRESHOLD, clock: Callable[[], int] | None = None):
        self.spark, self.store, self.max_memories, self.threshold = spark, store, max_memories, threshold
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.listeners: dict[str, list[Callable]] = defaultdict(list)
        self.state: Snapshot | None = None
        self._made: list[DataFrame] = []

    def init(self) -> MemoryGraph:
        """Load the store, or begin with empty tables."""
        self.state = self.store.load() if self.store else Snapshot(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))
        return self

    def _now(self) -> Snapshot:
        if self.state is None:
            raise RuntimeError("call init() first")
        return self.state

    def _durable(self, df: DataFrame, name: str) -> DataFrame:
        self._made.append(durable(df, name))
        return self._made[-1]

    def _set(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Make a new state; a table that is not given stays as it is."""
        state = self._now()
        self.state = Snapshot(state.nodes if nodes is None else self._durable(nodes, "nodes"), state.edges if edges is None else self._durable(edges, "edges"))

    def save(self, **marks: str) -> None:
        """Write a snapshot; ``marks`` are kept with it."""
        self.store.save(self._now(), **marks)

    def close(self) -> None:
        """Forget the state and delete its intermediate tables: results must have been read. The store's stay."""
        self.state = None
        for df in self._made:
            discard(df)
        self._made = []

    def on(self, event: str, listener: Callable) -> None:
        if event not in EVENTS:
            raise ValueError(f"no such event: {event}")
        self.listeners[event].append(listener)

    def off(self, event: str, listener: Callable) -> None:
        if listener in self.listeners[event]:
            self.listeners[event].remove(listener)

    def _emit(self, event: str, payload) -> None:
        for listener in list(self.listeners[event]):
            try:
                listener(payload)
            except Exception:  # noqa: BLE001  a listener's failure is its own
                pass

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Store many texts at once; ``rows`` has content and may have id, type, metadata, importance, summary.

        Links go from later to earlier rows, new ones among themselves included. Returns the new nodes. Listeners hear
        link:auto (of a row that has links) and node:created of each row in order, then of the evictions."""
        state, now = self._now(), self.clock()
        start = (state.nodes.agg(F.max("seq")).first()[0] or 0) + 1
        have = set(rows.columns)
        col = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
        # Ids are minted once, as the table is written; positions come from the order of the input's partitions.
        new = rows.withColumn("_p", F.monotonically_increasing_id())
        new = self._durable(new.select("_p", col("id", F.uuid()).alias("id"), F.col("content"), *(["summary"] if "summary" in have else []), col("type", F.lit("fact")).alias("type"), col("metadata", F.lit("{}")).alias("metadata"), col("importance", F.lit(DEFAULT_IMPORTANCE)).cast("double").alias("importance")), "new")
        parts = new.groupBy(F.shiftright("_p", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        base, at = [], start
        for r in parts:
            base.append((r["part"], at))
            at += r["n"]
        offsets = F.broadcast(self.spark.createDataFrame(base, "part long, base long"))
        new = new.join(offsets, F.shiftright("_p", 33) == F.col("part")).withColumn("seq", F.col("base") + F.col("_p") - F.shiftleft(F.shiftright("_p", 33), 33))
        if "summary" not in have:
            new = with_summary(new)
        for c in ("created_at", "updated_at", "last_accessed"):
            new = new.withColumn(c, F.lit(now))
        columns = [f.name for f in state.nodes.schema]
        new = self._durable(new.withColumn("access_count", F.lit(0).cast("long")).select(columns), "stored")
        nodes = state.nodes.unionByName(new)
        links = linking.auto_link(nodes, self.threshold, start)
        ids = nodes.select("seq", "id")
        edges = links.join(ids.withColumnsRenamed({"seq": "source_seq", "id": "source_id"}), "source_seq").join(ids.withColumnsRenamed({"seq": "target_seq", "id": "target_id"}), "target_seq")
        edges = edges.select(F.uuid().alias("id"), "source_id", "target_id", F.lit("relates_to").alias("relation"), "weight", F.lit("{}").alias("metadata"), F.lit(now).alias("created_at"))
        self._set(nodes, state.edges.unionByName(edges))
        self._tell_stored(new)
        self._evict()
        return new

    def _tell_stored(self, new: DataFrame) -> None:
        if not (self.listeners["link:auto"] or self.listeners["node:created"]):
            return
        links = self._now().edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("links"))
        for r in new.select("seq", "id").join(links, "id", "left").orderBy("seq").toLocalIterator():
            if r["links"]:
                self._emit("link:auto", {"id": r["id"], "links": r["links"]})
            self._emit("node:created", {"id": r["id"]})

    def store_text(self, content: str, **options) -> str:
        """Store one text; returns its id. Events: link:auto if it has links, then node:created."""
        node_id = str(uuid.uuid4())
        row = {"id": node_id, "content": content, "type": options.get("type", "fact"), "metadata": json.dumps(options.get("metadata", {})), "importance": float(options.get("importance", DEFAULT_IMPORTANCE))}
        if options.get("summary"):
            row["summary"] = options["summary"]
        self.ingest(self.spark.createDataFrame([row]))
        return node_id

    def _evict(self) -> None:
        state = self._now()
        if self.max_memories <= 0 or state.nodes.count() <= self.max_memories:
            return
        # A plain store evicts one row, a batch as many as came in: that bounds what is collected for the listeners.
        gone = [r["id"] for r in lifecycle.victims(state.nodes, self.max_memories).select("id").collect()]
        self._set(*lifecycle.forget(*state, self.spark.createDataFrame([(i,) for i in gone], "id string")))
        for i in gone:
            self._emit("node:deleted", {"id": i})
            self._emit("eviction", {"id": i})

    def retrieve(self, node_id: str):
        """The node as it was before this access, or None; the access is counted."""
        state = self._now()
        row = state.nodes.where(F.col("id") == node_id).first()
        if row:
            log = self.spark.createDataFrame([(node_id, self.clock())], "id string, ts long")
            self._set(nodes=lifecycle.fold_accesses(state.nodes, log))
            self._emit("node:updated", {"id": node_id})
        return row

    def search(self, query: str | search.SearchFilter, observed: bool = False) -> DataFrame:
        f = search.SearchFilter(query=query) if isinstance(query, str) else query
        nodes = self._now().nodes
        return fulltext.search(nodes, f, observed) if f.query else search.structured(nodes, f)

    def update(self, node_id: str, **fields) -> bool:
        state = self._now()
        if state.nodes.where(F.col("id") == node_id).isEmpty():
            return False
        if "metadata" in fields:
            fields["metadata"] = json.dumps(fields["metadata"])
        self._set(nodes=lifecycle.merge_updates(state.nodes, self.spark.createDataFrame([{"id": node_id, **fields}]), self.clock()))
        self._emit("node:updated", {"id": node_id})
        return True

    def forget(self, node_id: str) -> bool:
        state = self._now()
        if state.nodes.where(F.col("id") == node_id).isEmpty():
            return False
        self._set(*lifecycle.forget(*state, self.spark.createDataFrame([(node_id,)], "id string")))
        self._emit("node:deleted", {"id": node_id})
        return True

    def link(self, source: str, target: str, relation: str = "relates_to", weight: float = DEFAULT_WEIGHT) -> str:
        """Add an edge; raises, and changes nothing, if an end is missing or the edge exists."""
        state = self._now()
        new = self.spark.createDataFrame([(str(uuid.uuid4()), source, target, relation, float(weight), "{}", self.clock())], EDGES)
        edge = lifecycle.valid_links(state.nodes, state.edges, new).first()
        self._set(edges=state.edges.unionByName(new))
        self._emit("edge:created", {"id": edge["id"]})
        return edge["id"]

    def add_edge(self, source: str, target: str, relation: str = "relates_to", weight: float = DEFAULT_WEIGHT) -> str:
        """Add an edge without any check or event: its ends need not exist, and it may repeat another."""
        new = self.spark.createDataFrame([(str(uuid.uuid4()), source, target, relation, float(weight), "{}", self.clock())], EDGES)
        self._set(edges=graph.add_edges(self._now().edges, new))
        return new.first()["id"]

    def edge(self, edge_id: str):
        """The edge, or None."""
        return graph.edges_by_id(self._now().edges, self.spark.createDataFrame([(edge_id,)], "id string")).first()

    def unlink(self, edge_id: str) -> None:
        state = self._now()
        self._set(edges=lifecycle.drop_edges(state.edges, self.spark.createDataFrame([(edge_id,)], "id string")))

    def neighbours(self, node_id: str) -> DataFrame:
        state = self._now()
        found = graph.neighbours(state.nodes, graph.incident_edges(state.edges, node_id)).where(F.col("id") == node_id)
        return state.nodes.join(found.select(F.col("neighbour_id").alias("id")), "id", "left_semi")

    def edges_of(self, node_id: str) -> DataFrame:
        return graph.incident_edges(self._now().edges, node_id)

    def clusters(self, min_size: int = 2) -> DataFrame:
        return graph.clusters(*self._now(), min_size)

    def summarize(self) -> str:
        return corpus_summary(self._now().nodes).first()["summary"]

    def count(self) -> int:
        return self.state.nodes.count() if self.state else 0

    def clear(self) -> None:
        """Remove all nodes and edges, those in the store too; listeners hear nothing."""
        self.state = Snapshot(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))
        if self.store:
            self.save()
