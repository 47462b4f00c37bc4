"""Token ids in Parquet list columns: dictionary or delta encoding, small pages with page indexes, bounded row groups.

Files hold the documents in ascending doc_id order. Metadata columns (doc_id, n_tokens, at, part) stand beside the
list, so that readers of lengths and offsets never touch the ids, and a read of a few doc_ids opens only the row
groups and pages that hold them. ``at`` counts the ids before a document in its file; the few rows of ``offsets`` give
those before the file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.words import tidy
from quillgraph.llm.tokenizing import encoder
from quillgraph.plans.durable import shared_dir

#: Bytes of input, as the optimizer estimates it, for one file.
FILE = 8 << 20
SCHEMA = "doc_id long, part int, at long, n_tokens long, tokens array<int>"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, tail = TaskContext.get().partitionId(), 0, np.array([end], "<i4").tobytes()
        for batch in batches:
            for i, rows in encoder(path).column(batch.column(1)):
                n = np.array([len(x) // 4 + 1 for x in rows], np.int64)
                ends = np.cumsum(n)
                tokens = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(np.frombuffer(b"".join([x + tail for x in rows]), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), pa.array(np.full(len(rows), part, np.int32)), at + ends - n, n, tokens], ["doc_id", "part", "at", "n_tokens", "tokens"])
                at += int(ends[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, encoding: str = "dictionary", row_group: int = 16 << 20, page_rows: int = 200) -> None:
    """Encode the texts of ``docs`` (doc_id, text, ...; null: no ids), append ``end_id`` to each and write the files.

    ``encoding``: "dictionary", or "delta" for binary-packed deltas. Null doc_ids come first; rows that repeat a
    doc_id stand side by side in the order of their texts; null texts have the end id only. An empty table gives files
    without rows. The number of files follows the size of the input."""
    docs = docs.select("doc_id", "text")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # else there is no estimate
    n = max(1, -(-size // FILE)) if known else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(tidy(_encode(tokenizer, end_id)), SCHEMA).write.option("compression", "zstd")
    out = out.option("parquet.block.size", row_group).option("parquet.page.row.count.limit", page_rows).option("parquet.compression.codec.zstd.level", 1).option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
    if encoding == "delta":
        out = out.option("parquet.writer.version", "v2")
    out.parquet(path)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids before each file. One row a file is summed up on the driver."""
    parts = read(spark, path, ["doc_id", "part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    rows, before = [], 0
    for r in parts:  # range partitions are numbered in order
        rows.append((r["part"], before))
        before += r["n"]
    return spark.createDataFrame(rows, "part int, before long")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; only ``columns``, and only those of ``doc_ids``, which prunes row groups and pages."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if doc_ids is not None:
        df = df.where(F.col("doc_id").isin(doc_ids))
    return df.select(columns) if columns else df


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(3)
        flat = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<u4")
        offs = tokens.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offs, offs[1:])]
        n = np.diff(offs).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the stored documents, from the ids read back."""
    rows = read(spark, path, ["doc_id", "part", "at", "tokens"]).mapInArrow(tidy(_checksum), "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets(spark, path)), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
