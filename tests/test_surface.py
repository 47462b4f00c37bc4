"""The store, the stream, the command line, the server and the chat session."""

import json
import sqlite3
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quillgraph import cli, server
from quillgraph.facade import MemoryGraph
from quillgraph.operators import chat
from quillgraph.operators.search import SearchFilter, structured
from quillgraph.plans.paging import page
from quillgraph.schema import EDGES, NODES, iso
from quillgraph.session import ChatSession
from quillgraph.sources import connectors
from quillgraph.sources.store import OPS, ParquetStore
from quillgraph.streaming.ingest import access_windows, into_graph


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    store, source = ParquetStore(spark, str(tmp_path / "g")), str(tmp_path / "in")
    spark.createDataFrame([("dark mode is nice",), ("it rains today",)], "content string").coalesce(1).write.json(source)
    texts = spark.readStream.schema("content string").json(source)
    for k in range(2):  # the second driver has lost the checkpoint's progress, so it gets batch 0 again
        place = str(tmp_path / "ck")
        if k:
            for folder in ("offsets", "commits", "sources"):
                (tmp_path / "ck" / folder).rename(tmp_path / f"lost-{folder}")
        g = MemoryGraph(spark, store).init()
        into_graph(texts, g, place, available_now=True).awaitTermination()
        assert g.count() == 2 and ParquetStore(spark, store.root).load().nodes.count() == 2
    g.save()
    assert store.marks() == {f"stream {tmp_path / 'ck'}": "0"}  # later snapshots keep the mark
    spark.createDataFrame([("new text",)], "content string").coalesce(1).write.mode("append").json(source)
    into_graph(texts, g, place, available_now=True).awaitTermination()
    assert g.count() == 3


def test_access_windows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:02:00"), ("b", "2024-01-01 00:06:00"), ("z", "2024-01-01 09:00:00")], "id string, ts string")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = access_windows(spark.readStream.schema("id string, ts timestamp").json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["id"], r["accesses"]) for r in spark.table("seen").collect()} == {("a", 2), ("b", 1)}


def test_batches_tell_listeners(spark):
    g, heard = MemoryGraph(spark, max_memories=2, clock=lambda: 1).init(), []
    for e in ("link:auto", "node:created", "node:deleted", "eviction"):
        g.on(e, lambda x, e=e: heard.append((e, x["id"])))
    g.ingest(spark.createDataFrame([("a", "dark mode"), ("b", "dark mode"), ("c", "sunny weather")], "id string, content string").coalesce(1))
    assert heard == [("node:created", "a"), ("link:auto", "b"), ("node:created", "b"), ("node:created", "c"), ("node:deleted", "a"), ("eviction", "a")]


def test_edges_without_checks(spark, tmp_path):
    g = MemoryGraph(spark, ParquetStore(spark, str(tmp_path / "g")), threshold=0).init()
    a = g.store_text("alone")
    e = g.add_edge(a, "nobody", "supports", 0.25)
    assert g.edge(e)["target_id"] == "nobody" and g.edge("none") is None and g.add_edge(a, "nobody", "supports") != e
    assert g.neighbours(a).count() == 0 and g.edges_of(a).count() == 2
    g.unlink(e)
    assert g.edge(e) is None
    g.save()
    g.clear()
    assert g.count() == 0 and g.store.load().edges.count() == 0
    made = [df._durable_path for df in g._made]
    g.close()
    assert made and not any((tmp_path.__class__(p)).exists() for p in made)
    with pytest.raises(RuntimeError):
        g.search("alone")


def test_ops_log(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "g"))
    row = lambda i, text: {"seq": i, "id": str(i), "content": text, "summary": "", "type": "fact", "metadata": "{}", "importance": 0.5, "created_at": 1, "updated_at": 1, "last_accessed": 1, "access_count": 0}
    from quillgraph.sources.store import Snapshot

    store.save(Snapshot(spark.createDataFrame([row(1, "a"), row(2, "b")], NODES), spark.createDataFrame([], EDGES)))
    store.append(spark.createDataFrame([(1, "upsert", "1", json.dumps(row(1, "changed")), 1), (2, "delete", "2", None, 1), (3, "upsert", "3", json.dumps(row(3, "c")), 1)], OPS))
    store.append(spark.createDataFrame([(4, "delete", "3", None, 1)], OPS))
    assert [(r["id"], r["content"]) for r in store.load().nodes.collect()] == [("1", "changed")]


def test_connectors(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"a": 1}\n\n  \n{"a": 2, "b": "x"}\nnot json\n')
    rows = connectors.read_ndjson(spark, str(tmp_path / "x.ndjson"), "a int, b string")
    assert [tuple(r) for r in rows.collect()] == [(1, None), (2, "x"), (None, None)]
    assert [r["value"] for r in connectors.to_json_lines(rows.limit(2)).collect()] == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE nodes (id TEXT, importance REAL, created_at INTEGER)")
        db.executemany("INSERT INTO nodes VALUES (?, ?, ?)", [(str(i), i / 10, i) for i in range(25)])
        db.execute("CREATE TABLE none (id TEXT)")
    spark.dataSource.register(connectors.SqliteSource)
    read = spark.read.format("sqlite_file").option("path", path)
    got = read.option("dbtable", "nodes").option("numPartitions", 4).load()
    assert got.rdd.getNumPartitions() == 4 and sorted(r["created_at"] for r in got.collect()) == list(range(25))
    assert read.option("dbtable", "none").load().count() == 0


def test_metadata_keys_with_marks(spark):
    nodes = spark.createDataFrame([(1, '{"a\'b": "x", "n": 1, "c.d": true}', 0), (2, "broken", 0), (3, None, 0)], "seq long, metadata string, updated_at long")
    for found in ({"a'b": "x"}, {"n": "1"}, {"c.d": "true"}):
        assert [r["seq"] for r in structured(nodes, SearchFilter(metadata=found)).collect()] == [1]
    assert structured(nodes, SearchFilter(metadata={"z": "1"})).count() == 0


def test_deep_pages(spark):
    rows = spark.range(1000, numPartitions=7).select(F.col("id").alias("seq"), ((F.col("id") * 37) % 11).alias("k"))
    want = sorted(range(1000), key=lambda i: (-(i * 37 % 11), i))
    for limit, offset in ((10, 0), (10, 30), (400, 0), (400, 500), (400, 800), (-1, 0), (-1, 990), (0, 700), (5, 2000)):
        for top in (0, 50, 100_000):
            got = page(rows, [F.desc("k"), F.asc("seq")], limit, offset, top)
            assert got.columns == rows.columns and [r["seq"] for r in got.collect()] == want[offset:][: limit if limit >= 0 else None]
    assert page(rows.where("false"), [F.col("seq")], 5, 0, 0).count() == 0


def test_iso(spark):
    rows = spark.createDataFrame([(0,), (1704067200123,), (-1,), (None,)], "t long")
    assert [r[0] for r in rows.select(iso("t")).collect()] == ["1970-01-01T00:00:00.000Z", "2024-01-01T00:00:00.123Z", "1969-12-31T23:59:59.999Z", None]


def test_command_line(spark, tmp_path, capsys):
    def run(*args):
        code = cli.main(["--db", str(tmp_path / "g"), *args], spark)
        return code, capsys.readouterr().out.strip()

    code, one = run("store", "user prefers dark mode", "--type", "preference")
    two = run("store", "dark mode saves power")[1]
    assert code == 0 and run("count")[1] == "2" and run("search", "power")[1].startswith("[fact]")
    code, text = run("retrieve", one)
    assert code == 0 and text.startswith("[preference] user prefers dark mode\n  ID: " + one) and text.endswith("Z")
    assert run("retrieve", "nobody")[0] == 1 and run("link", one, two, "supports")[0] == 0
    assert "--[supports]-->" in run("graph")[1] and run("summarize")[1]
    assert json.loads(run("--json", "retrieve", one)[1])["access_count"] == 1
    assert run("forget", one) == (0, "True") and run("forget", one)[0] == 1 and run("count")[1] == "1"


def test_server(spark, tmp_path):
    g = MemoryGraph(spark, ParquetStore(spark, str(tmp_path / "g"))).init()
    post = lambda path, body=None, raw=None: server.answer(g, "POST", "/api/mem" + path, raw if raw is not None else json.dumps(body or {}).encode())
    assert server.answer(g, "GET", "/health") == (200, {"status": "ok", "service": "quillgraph"})
    status, first = post("/store", {"content": "user prefers dark mode", "metadata": {"k": [1]}, "importance": 1})
    assert status == 200 and first["links"] == [] and first["node"]["metadata"] == {"k": [1]} and first["node"]["accessCount"] == 0
    second = post("/store", {"content": "dark mode is on", "type": "context", "summary": "s"})[1]
    a, b = first["node"]["id"], second["node"]["id"]
    assert second["links"][0]["targetId"] == a and second["node"]["summary"] == "s"
    for path, body, status in (("/store", {}, 422), ("/store", {"content": ""}, 422), ("/store", {"content": "x", "importance": 2}, 422), ("/search", {"limit": 0}, 422), ("/search", {"query": "what?"}, 400),
                               ("/search", {"sort_order": "up"}, 400), ("/retrieve", {}, 400), ("/retrieve", {"id": "x"}, 404), ("/forget", {"id": "x"}, 404), ("/link", {"source_id": a, "target_id": "x"}, 400),
                               ("/neighbours", {}, 400), ("/update?node_id=x", {"type": "fact"}, 404), ("/update", {}, 422), ("/nothing", {}, 404), ("/count", {}, 405)):
        assert post(path, body)[0] == status, path
    assert post("/store", raw=b"{")[0] == 422 and post("/store", raw=b"[]")[0] == 422
    assert [x["node"]["id"] for x in post("/search", {"query": "prefers"})[1]] == [a]
    assert [x["node"]["id"] for x in post("/search", {"min_importance": 0.9})[1]] == [a]
    assert post("/retrieve", {"id": a})[1]["accessCount"] == 0 and post("/retrieve", {"id": a})[1]["accessCount"] == 1
    assert post("/link", {"source_id": a, "target_id": b, "relation": "supports"})[1]["relation"] == "supports"
    assert post("/update?node_id=" + a, {"importance": 0, "metadata": {}})[1]["importance"] == 0
    http = server.serve(g)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{http.server_port}"
        whole = json.load(urllib.request.urlopen(url + "/api/mem/graph"))
        assert {x["id"] for x in whole["nodes"]} == {a, b} and len(whole["edges"]) == 2
        near = urllib.request.Request(url + "/api/mem/neighbours", json.dumps({"nodeId": a}).encode())
        assert [x["id"] for x in json.load(urllib.request.urlopen(near))] == [b]
        assert json.load(urllib.request.urlopen(url + "/api/mem/count")) == {"count": 2}
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(url + "/nothing")
    finally:
        http.shutdown()
        http.server_close()
    assert post("/forget", {"id": a}) == (200, {"deleted": True, "id": a}) and ParquetStore(spark, g.store.root).load().nodes.count() == 1
    assert post("/summarize")[1]["summary"]
    g.close()
    assert post("/summarize")[0] == 503


def test_chat_session(spark):
    s = ChatSession(MemoryGraph(spark).init(), types=("fact",))
    sent = []
    assert s.say("I prefer dark mode in all my apps", lambda m: sent.append(m) or "Noted.") == "Noted."
    assert sent[0] == [{"role": "system", "content": chat.NO_MEMORIES}, {"role": "user", "content": "I prefer dark mode in all my apps"}]
    assert s.say("dark mode?", lambda m: sent.append(m) or "") == "" and "1. [fact] I prefer dark mode" in sent[1][0]["content"]
    assert [m["role"] for m in s.history] == ["user", "assistant", "user"] and s.graph.count() == 1  # short ones are not stored
    other = s.remember("dark chocolate", type="preference")
    assert s.recall("dark").count() == 1 and s.recall("?!").count() == 0
    s.types = ()
    assert s.recall("dark").count() == 2 and s.recall("dark", 1).count() == 1
    s.clear()
    assert s.history == [] and s.graph.count() == 2 and s.summarize_all()
    assert s.forget(other) and not s.forget(other) and s.healthy()
    s.graph.close()
    assert not s.forget(other) and not s.healthy()
