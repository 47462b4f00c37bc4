"""Intermediate tables that survive the loss of executors.

Lineage is cut by writing Parquet below the folder that the session names in ``spark.checkpoint.dir``; only where
that is unset (tests, a laptop) a temporary folder is chosen and set.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a one-column key table is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable tables, as ``spark.checkpoint.dir`` has it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back with the same schema."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a durable table that nothing reads any more."""
    path = getattr(df, "_durable_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df``, with a broadcast hint if it has no more than ``rows`` rows. ``df`` should be durable: it is counted.

    ``weight`` is what a row counts for, as of a column of arrays their size."""
    if weight is None:
        small = df.limit(rows + 1).count() <= rows
    else:
        small = (df.agg(F.sum(weight)).first()[0] or 0) <= rows
    return F.broadcast(df) if small else df
