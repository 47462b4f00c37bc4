"""The graph over HTTP, with the standard library's server: JSON in and out below /api/mem, and /health.

A thin layer: requests are checked, one at a time goes to the facade, and tables are streamed row by row.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.facade import MemoryGraph
from quillgraph.operators.fulltext import QueryError
from quillgraph.operators.lifecycle import NotFound
from quillgraph.operators.search import SearchFilter
from quillgraph.schema import DEFAULT_IMPORTANCE, DEFAULT_WEIGHT

# Where the routes are, and the bounds of a page.
PREFIX, PAGE, MOST = "/api/mem", 20, 1000


class Refused(Exception):
    """A request that gets an error status: (status, detail)."""


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(map(str.title, rest))


def as_json(df: DataFrame) -> DataFrame:
    """(value): rows as JSON objects with names in camel case and the metadata as an object."""
    shown = [c for c in df.columns if c != "seq"]
    parsed = [F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}"))).alias("metadata") if c == "metadata" else F.col(c).alias(_camel(c)) for c in shown]
    return df.select(F.to_json(F.struct(*parsed), {"ignoreNullFields": "false"}).alias("value"))


def _lines(df: DataFrame) -> Iterator[str]:
    for i, r in enumerate(as_json(df).toLocalIterator()):
        yield ("," if i else "") + r["value"]


def _one(df: DataFrame) -> dict | None:
    row = as_json(df).first()
    return json.loads(row["value"]) if row else None


def _given(body: dict, key: str, kind: type | tuple, default=None, low=None, high=None, required: bool = False):
    """A field of a request; 422 if it is missing, of another type or out of bounds."""
    value = body.get(key)
    if value is None:
        if required:
            raise Refused(422, f"{key}: required")
        return default
    if not isinstance(value, kind) or isinstance(value, bool):
        raise Refused(422, f"{key}: wrong type")
    if (low is not None and value < low) or (high is not None and value > high):
        raise Refused(422, f"{key}: out of bounds")
    return value


_NUMBER = (int, float)


def _store(g: MemoryGraph, body: dict, _):
    content = _given(body, "content", str, required=True)
    if not content:
        raise Refused(422, "content: empty")
    options = {"type": _given(body, "type", str, "fact"), "metadata": _given(body, "metadata", dict, {}), "importance": _given(body, "importance", _NUMBER, DEFAULT_IMPORTANCE, 0, 1), "summary": _given(body, "summary", str)}
    node_id = g.store_text(content, **options)
    links = [json.loads(r["value"]) for r in as_json(g.state.edges.where(F.col("source_id") == node_id)).toLocalIterator()]
    return {"node": _node(g, node_id), "links": links}


def _node(g: MemoryGraph, node_id: str) -> dict | None:
    return _one(g.state.nodes.where(F.col("id") == node_id))


def _retrieve(g: MemoryGraph, body: dict, _):
    node_id = body.get("id")
    if not node_id:
        raise Refused(400, "id: missing")
    node = _node(g, node_id)
    if not node:
        raise Refused(404, f"not found: {node_id}")
    g.retrieve(node_id)
    return node


def _search(g: MemoryGraph, body: dict, _):
    f = {
        "query": _given(body, "query", str), "type": _given(body, "type", str), "metadata": _given(body, "metadata", dict, {}),
        "min_importance": _given(body, "min_importance", _NUMBER, None, 0, 1), "max_importance": _given(body, "max_importance", _NUMBER, None, 0, 1),
        "limit": _given(body, "limit", int, PAGE, 1, MOST), "offset": _given(body, "offset", int, 0, 0),
        "sort_by": _camel(_given(body, "sort_by", str, "updated_at")), "sort_order": _given(body, "sort_order", str, "desc"),
    }
    found = [json.loads(r["value"]) for r in as_json(g.search(SearchFilter(**f))).collect()]  # at most a page
    return [{"score": x.pop("score"), "node": x} for x in found]


def _forget(g: MemoryGraph, body: dict, _):
    node_id = _given(body, "id", str, required=True)
    if not g.forget(node_id):
        raise Refused(404, f"not found: {node_id}")
    return {"deleted": True, "id": node_id}


def _link(g: MemoryGraph, body: dict, _):
    ends = [_given(body, k, str, required=True) for k in ("source_id", "target_id")]
    edge_id = g.link(*ends, _given(body, "relation", str, "relates_to"), _given(body, "weight", _NUMBER, DEFAULT_WEIGHT, 0, 1))
    return _one(g.state.edges.where(F.col("id") == edge_id))


def _graph(g: MemoryGraph, body: dict, _) -> Iterator[str]:
    state = g.state  # tables do not change, so the answer is of one moment

    def parts():
        yield '{"nodes":['
        yield from _lines(state.nodes)
        yield '],"edges":['
        yield from _lines(state.edges)
        yield "]}"

    return parts()


def _neighbours(g: MemoryGraph, body: dict, _) -> Iterator[str]:
    if not body.get("nodeId"):
        raise Refused(400, "nodeId: missing")
    found = g.neighbours(body["nodeId"])

    def parts():
        yield "["
        yield from _lines(found)
        yield "]"

    return parts()


def _update(g: MemoryGraph, body: dict, query: dict):
    node_id = (query.get("node_id") or [""])[0]
    if not node_id:
        raise Refused(422, "node_id: required")
    fields = {k: _given(body, k, kind) for k, kind in {"content": str, "summary": str, "type": str, "metadata": dict}.items()}
    fields["importance"] = _given(body, "importance", _NUMBER, None, 0, 1)
    fields = {k: float(v) if k == "importance" else v for k, v in fields.items() if v is not None}
    if not g.update(node_id, **fields):
        raise Refused(404, f"not found: {node_id}")
    return _node(g, node_id)


ROUTES: dict[tuple[str, str], Callable] = {
    ("POST", "/store"): _store,
    ("POST", "/retrieve"): _retrieve,
    ("POST", "/search"): _search,
    ("POST", "/forget"): _forget,
    ("POST", "/summarize"): lambda g, body, query: {"summary": g.summarize()},
    ("POST", "/link"): _link,
    ("GET", "/graph"): _graph,
    ("POST", "/neighbours"): _neighbours,
    ("GET", "/count"): lambda g, body, query: {"count": g.count()},
    ("POST", "/update"): _update,
}
#: Routes after which the graph is written, if it has a store.
WRITES = {"/store", "/retrieve", "/forget", "/link", "/update"}


def answer(g: MemoryGraph, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
    """(status, what to send): an object, or an iterator of the pieces of its JSON."""
    url = urlsplit(target)
    if (method, url.path) == ("GET", "/health"):
        return 200, {"status": "ok", "service": "quillgraph"}
    path = url.path.removeprefix(PREFIX)
    run = ROUTES.get((method, path)) if url.path.startswith(PREFIX) else None
    if not run:
        known = url.path.startswith(PREFIX) and any(p == path for _, p in ROUTES)
        return (405, {"detail": "method not allowed"}) if known else (404, {"detail": "no such route"})
    if g.state is None:
        return 503, {"detail": "the graph is closed"}
    try:
        given = json.loads(body or b"{}")
        if not isinstance(given, dict):
            raise Refused(422, "the body must be an object")
        out = run(g, given, parse_qs(url.query))
        if path in WRITES and g.store:
            g.save()
        return 200, out
    except Refused as e:
        return e.args[0], {"detail": e.args[1]}
    except ValueError as e:  # JSON that does not parse, queries and filters that are not valid
        return (422 if isinstance(e, json.JSONDecodeError) else 400), {"detail": str(e)}
    except (NotFound, QueryError) as e:
        return 400, {"detail": str(e)}


def serve(g: MemoryGraph, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; port 0 takes a free one. Requests change the graph one at a time."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _run(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            with lock:
                status, out = answer(g, self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            for part in out if isinstance(out, Iterator) else [json.dumps(out)]:
                self.wfile.write(part.encode())

        do_GET = do_POST = _run

        def do_OPTIONS(self):
            self.send_response(204)
            for name, value in (("Origin", "*"), ("Methods", "GET, POST"), ("Headers", "*")):
                self.send_header(f"Access-Control-Allow-{name}", value)
            self.end_headers()

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
