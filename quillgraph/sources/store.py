"""A graph store on any file system that Spark writes: immutable snapshots of both tables and an append-only ops log.

``root/snapshot-N/{nodes,edges}`` are Parquet; the largest N whose folder has the file _DONE is current, so a reader
never sees half a snapshot; _DONE holds the snapshot's marks as JSON. ``root/ops`` takes changes as rows (seq, op, id, payload, ts); the state is the snapshot with the latest op
of each id folded in.
"""

from __future__ import annotations

import json
import os
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.lifecycle import latest
from quillgraph.schema import EDGES, NODES

OPS = "seq long, op string, id string, payload string, ts long"


class Snapshot(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


class Storage(Protocol):
    """What a store must offer; external systems can stand behind it."""

    def load(self) -> Snapshot: ...

    def save(self, state: Snapshot, **marks: str) -> None: ...

    def append(self, ops: DataFrame) -> None: ...


def default_root() -> str:
    """Below the home folder, else the current one."""
    home = os.environ.get("HOME") or os.environ.get("USERPROFILE") or "."
    return os.path.join(home, ".quillgraph")


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or default_root()).rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The current snapshot's number; 0 if there is none."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))]
        found = [int(n[9:]) for n in names if n.startswith("snapshot-") and fs.exists(self._path(f"{n}/_DONE"))]
        return max(found, default=0)

    def load(self) -> Snapshot:
        """The current snapshot with the ops since; empty tables in a new store."""
        n = self.version()
        if not n:
            state = Snapshot(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))
        else:
            read = self.spark.read
            state = Snapshot(read.schema(NODES).parquet(f"{self.root}/snapshot-{n}/nodes"), read.schema(EDGES).parquet(f"{self.root}/snapshot-{n}/edges"))
        return Snapshot(fold(state.nodes, self.ops("nodes"), NODES), fold(state.edges, self.ops("edges"), EDGES))

    def ops(self, table: str) -> DataFrame:
        path = f"ops/{table}-{self.version()}"
        if not self._fs().exists(self._path(path)):
            return self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(f"{self.root}/{path}")

    def append(self, ops: DataFrame, table: str = "nodes") -> None:
        """Add rows (seq, op: upsert or delete, id, payload: the row as JSON, ts) to the log of the current snapshot."""
        ops.select("seq", "op", "id", "payload", "ts").write.mode("append").parquet(f"{self.root}/ops/{table}-{self.version()}")

    def marks(self) -> dict[str, str]:
        """What was kept with the current snapshot, such as how far a stream has come."""
        n = self.version()
        if not n:
            return {}
        stream = self._fs().open(self._path(f"snapshot-{n}/_DONE"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text or "{}")

    def save(self, state: Snapshot, **marks: str) -> None:
        """Write a new snapshot and make it current; the logs of the one before no longer count. Older marks stay."""
        n, marks = self.version() + 1, self.marks() | marks
        for name, df in zip(("nodes", "edges"), state):
            df.write.mode("overwrite").parquet(f"{self.root}/snapshot-{n}/{name}")
        # The file counts from the moment it has its name, so it gets that last.
        done, part = self._path(f"snapshot-{n}/_DONE"), self._path(f"snapshot-{n}/_PART")
        out = self._fs().create(part)
        out.write(bytearray(json.dumps(marks).encode()))
        out.close()
        self._fs().rename(part, done)


def fold(table: DataFrame, ops: DataFrame, schema: str) -> DataFrame:
    """``table`` (id, ...) with the latest op of each id: an upsert's payload replaces the row, a delete removes it."""
    last = latest(ops)
    kept = table.join(last.select("id"), "id", "left_anti").select(table.columns)
    new = last.where("op = 'upsert'").select(F.from_json("payload", schema).alias("x")).select("x.*")
    return kept.unionByName(new)
