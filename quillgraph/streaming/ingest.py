"""Structured Streaming into a MemoryGraph: each micro-batch of texts is one ingest, and events go out per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.facade import MemoryGraph


def into_graph(texts: DataFrame, graph: MemoryGraph, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Store a stream (content, ...) in ``graph``.

    A graph with a store writes a snapshot for each batch, with the batch's number in it, so a batch that is replayed
    after a failure, by another driver too, is stored once. Without a store that holds for this object's life."""
    mark = "stream " + checkpoint.rstrip("/")
    done = int(graph.store.marks().get(mark, -1)) if graph.store else -1

    def store(batch: DataFrame, epoch: int) -> None:
        nonlocal done
        if epoch <= done:
            return
        if not batch.isEmpty():
            graph.ingest(batch)
            if graph.store:
                graph.save(**{mark: str(epoch)})
        done = epoch

    writer = texts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def access_windows(accesses: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Accesses (id, ts timestamp) counted per node and window, closed when the watermark has passed."""
    return accesses.withWatermark("ts", late).groupBy(F.window("ts", width), "id").agg(F.count("*").alias("accesses")).select("id", F.col("window.start").alias("from"), "accesses")
