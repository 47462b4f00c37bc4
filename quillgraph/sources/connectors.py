"""Connectors: line-delimited JSON in and out, and a reader of SQLite files as a Python data source."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are skipped, lines that do not parse give null fields."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def to_json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_file")`` with the options path, dbtable, and numPartitions to split by rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}
        with sqlite3.connect(self.options["path"]) as db:
            rows = db.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["dbtable"],)).fetchall()
        return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for name, kind in rows)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.columns = options["path"], options["dbtable"], [f.name for f in schema]
        self.parts = int(options.get("numPartitions", 1))

    def partitions(self):
        with sqlite3.connect(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        step = -(-(high - low + 1) // self.parts)
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(self.path) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', partition.value)
