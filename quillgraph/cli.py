"""Command line: python -m quillgraph.cli [--db PATH] COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quillgraph.facade import MemoryGraph
from quillgraph.operators.graph import report
from quillgraph.operators.search import SearchFilter
from quillgraph.schema import iso
from quillgraph.server import serve
from quillgraph.sources.store import ParquetStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--db")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"store": ["text"], "retrieve": ["id"], "search": ["query"], "forget": ["id"], "summarize": [], "graph": [], "serve": [], "link": ["source", "target"], "count": []}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name in ("store", "search"):
            s.add_argument("--type")
        if name == "search":
            s.add_argument("--limit", type=int, default=10)
        if name == "serve":
            s.add_argument("--host", default="127.0.0.1")
            s.add_argument("--port", type=int, default=7400)
        if name == "link":
            s.add_argument("relation", nargs="?", default="relates_to")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillgraph").getOrCreate()
    g = MemoryGraph(spark, ParquetStore(spark, a.db)).init()
    if a.command == "serve":
        serve(g, a.host, a.port).serve_forever()
    rows, done = [], True
    if a.command == "store":
        rows = [{"id": g.store_text(a.text, **({"type": a.type} if a.type else {}))}]
    elif a.command == "retrieve":
        row = g.retrieve(a.id)
        rows, done = ([row.asDict()] if row else []), bool(row)
        if not row:
            print(f"not found: {a.id}", file=sys.stderr)
    elif a.command == "search":
        rows = [r.asDict() for r in g.search(SearchFilter(query=a.query, type=a.type, limit=a.limit)).collect()]
    elif a.command == "forget":
        done = g.forget(a.id)
        rows = [{"forgotten": done}]
    elif a.command == "summarize":
        rows = [{"summary": g.summarize()}]
    elif a.command == "graph":
        rows = [r.asDict() for r in report(*g.state).toLocalIterator()]
    elif a.command == "link":
        rows = [{"id": g.link(a.source, a.target, a.relation)}]
    elif a.command == "count":
        rows = [{"count": g.count()}]
    if a.command in ("store", "retrieve", "forget", "link") and done:
        g.save()
    for r in rows:
        if a.command == "search" and not a.json:
            print(f"[{r['type']}] {'%.3f' % r['score']} {r['content'][:60]}")
        elif a.command == "retrieve" and not a.json:
            created = spark.range(1).select(iso(str(r["created_at"]))).first()[0]
            print(f"[{r['type']}] {r['content']}\n  ID: {r['id']}\n  Importance: {r['importance']}\n  Access count: {r['access_count']}\n  Created: {created}")
        else:
            print(json.dumps(r) if a.json else "  ".join(str(v) for v in r.values()))
    return 0 if done else 1


if __name__ == "__main__":
    raise SystemExit(main())
