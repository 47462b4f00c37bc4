import math
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillgraph.facade import MemoryGraph
from quillgraph.functions.text import STOP_WORDS, SUMMARY_STOP_WORDS, register, text_similarity, with_summary
from quillgraph.operators import chat, fulltext, graph, lifecycle, linking
from quillgraph.operators.components import connected_components
from quillgraph.operators.search import SearchFilter, structured
from quillgraph.operators.textindex import TextIndex
from quillgraph.sources.store import ParquetStore


def similarity(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(text_similarity(F.col("a"), F.col("b"))).first()[0]


def test_similarity(spark):
    assert len(STOP_WORDS) == 96 and len(SUMMARY_STOP_WORDS) == 45 and set(SUMMARY_STOP_WORDS) < set(STOP_WORDS)
    assert similarity(spark, "same words here", "same words here") == 1
    assert similarity(spark, "user prefers dark mode", "user likes dark mode themes") == pytest.approx(3 / math.sqrt(20))
    assert similarity(spark, "", "word") == 0
    register(spark)
    assert spark.sql("SELECT text_similarity('dark mode', 'dark themes')").first()[0] == pytest.approx(0.5)
    assert spark.sql("SELECT extractive_summary('short.')").first()[0] == "short."


def test_summary(spark):
    rows = [(1, "short."), (2, "One long sentence here."), (3, "Cats like fish a lot. Dogs like bones and fish. Fish fish fish fish."), (4, ""), (5, "y" * 300)]
    out = {r["k"]: r["summary"] for r in with_summary(spark.createDataFrame(rows, "k long, content string")).collect()}
    assert out == {1: "short.", 2: "One long sentence here.", 3: "Fish fish fish fish.", 4: "", 5: "y" * 300}


def test_links_agree_with_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 8)))) for i in range(60)]
    bags = {i: {w for w in re.split(r"\s+", t) if len(w) > 1} for i, t in rows}
    nodes = spark.createDataFrame(rows, "seq long, content string")
    for t in (0.3, 0.7):
        want = {(a, b) for a in bags for b in bags if a > b and bags[a] and bags[b] and len(bags[a] & bags[b]) / math.sqrt(len(bags[a]) * len(bags[b])) >= t}
        assert {(x[0], x[1]) for x in linking.auto_link(nodes, t).collect()} == want
    assert linking.auto_link(nodes, 0).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3)]
    found = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {i: i for e in edges[:-1] for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges[:-1]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert found == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fulltext_ranks_like_sqlite(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "naïve"]
    rows = [(i, str(i), " ".join(r.choices(words, k=r.randint(1, 12))), " ".join(r.choices(words, k=2))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content, summary)")
    db.executemany("INSERT INTO t(rowid, content, summary) VALUES (?, ?, ?)", [(i + 1, c, s) for i, _, c, s in rows])
    nodes = spark.createDataFrame(rows, "seq long, id string, content string, summary string").cache()
    index = TextIndex(spark).add(nodes.where("seq < 25")).add(nodes.where("seq >= 25"))
    for q in ("alpha beta", "alpha OR delta", "alpha NOT beta", '"alpha beta"', "alph*", "summary : gamma", "NEAR(alpha beta, 2)", "^alpha", "naive", "(alpha OR beta) AND gamma",
              "summary : (alpha OR beta)", "{content summary} : beta", "- summary : alpha", "content : (alpha summary : beta)", "- {content} : gamma NOT delta", "summary : NEAR(alpha beta)", "^alp* OR \"beta gamma\""):
        want = {i - 1: round(s, 9) for i, s in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (q,))}
        got = {x["seq"]: round(x["score"], 9) for x in fulltext.ranked(nodes, q).collect()}
        assert got == pytest.approx(want, abs=1e-8), q
        got = {x["seq"]: round(x["score"], 9) for x in index.ranked(q).collect()}
        assert got == pytest.approx(want, abs=1e-8), q
    for bad in ("", "dark-mode", "what?", "it's", "AND", "(alpha"):
        with pytest.raises(fulltext.QueryError):
            fulltext.Parsed(bad)
    assert fulltext.plain("What theme?") == '"What" "theme"'


def test_index_follows_changes_like_sqlite(spark):
    r = random.Random(5)
    make = lambda k: " ".join(r.choices(["alpha", "beta", "gamma", "Δέλτα", "ﾃ", "Ệ"], k=k))
    rows = {i: (make(r.randint(0, 9)), make(2)) for i in range(1, 31)}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content, summary)")
    frame = lambda ids: spark.createDataFrame([(i, *rows[i]) for i in ids], "seq long, content string, summary string")
    index = TextIndex(spark).add(frame(rows))
    gone, changed = range(3, 9), range(7, 20, 3)
    index.remove(spark.createDataFrame([(i,) for i in [*gone, 99]], "seq long"))
    rows = {i: v for i, v in rows.items() if i not in gone} | {i: (make(5), "alpha") for i in changed}
    index.update(frame(changed))
    db.executemany("INSERT INTO t(rowid, content, summary) VALUES (?, ?, ?)", [(i, c, s) for i, (c, s) in rows.items()])
    for q in ("alpha", "beta NOT gamma", "alpha OR δέλτα", "alpha OR e", "alpha OR ệ", "alpha OR δελτα"):
        want = {i: s for i, s in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (q,))}
        assert {x["seq"]: x["score"] for x in index.ranked(q).collect()} == pytest.approx(want, abs=1e-8), q
    assert index.rows == len(rows) and {x["term"]: x["rows"] for x in index.terms().collect()}["alpha"] == sum("alpha" in c + s for c, s in rows.values())


def test_links_of_new_nodes(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(25)], k=r.randint(0, 8)))) for i in range(50)]
    nodes = spark.createDataFrame(rows, "seq long, content string")
    for t in (0.3, 0.7):
        every = {tuple(x) for x in linking.auto_link(nodes, t).collect()}
        assert {tuple(x) for x in linking.auto_link(nodes, t, 40).collect()} == {x for x in every if x[0] >= 40}


def test_structured_search(spark):
    rows = [(i, "fact" if i % 2 else "entity", i / 10, '{"k":"%d"}' % (i % 3), i, i, 10 - i) for i in range(10)]
    nodes = spark.createDataFrame(rows, "seq long, type string, importance double, metadata string, created_at long, updated_at long, access_count long")
    run = lambda **k: [r["seq"] for r in structured(nodes, SearchFilter(**k)).collect()]
    assert run(type="fact", min_importance=0.3) == [9, 7, 5, 3]
    assert run(max_importance=0.0) == [0]
    assert run(metadata={"k": "1"}, sort_order="asc") == [1, 4, 7]
    assert run(limit=3, offset=2) == [7, 6, 5]
    assert len(run(limit=-1)) == 10
    assert run(sort_by="relevance", limit=1) == [9]
    with pytest.raises(ValueError):
        SearchFilter(sort_order="desc; drop")


def test_eviction_equals_the_loop(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0.1, 0.5]), r.randint(0, 3)) for i in range(30)]
    live = []
    for row in rows:
        live.append(row)
        if len(live) > 8:
            live.remove(min(live, key=lambda x: (x[1], x[2], x[0])))
    nodes = spark.createDataFrame(rows, "seq long, importance double, last_accessed long")
    assert {x["seq"] for x in lifecycle.evict(nodes, 8).collect()} == {x[0] for x in live}


def test_graph_operators(spark):
    nodes = spark.createDataFrame([("a", "A text"), ("b", "B"), ("c", "C"), ("d", "D")], "id string, content string")
    edges = spark.createDataFrame([("e1", "a", "b", "r"), ("e2", "b", "c", "r"), ("e3", "a", "a", "r"), ("e4", "a", "gone", "r")], "id string, source_id string, target_id string, relation string")
    assert {(x[0], x[1]) for x in graph.neighbours(nodes, edges).collect()} >= {("a", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    assert graph.incident_edges(edges, "a").count() == 3
    kept = graph.clusters(nodes, edges.where("target_id <> 'gone'"))
    assert {x["id"] for x in kept.collect()} == {"a", "b", "c"}
    left = lifecycle.forget(nodes, edges, spark.createDataFrame([("b",)], "id string"))
    assert left[0].count() == 3 and {x["id"] for x in left[1].collect()} == {"e3", "e4"}


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "system", "x")], "conv_id long, turn long, role string, text string")
    assert chat.transcript(turns).first()["transcript"] == "Human: hi\nAI: hello\nsystem: x"
    assert chat.to_store(turns).count() == 0
    none = spark.createDataFrame([], "rank long, type string, content string")
    assert chat.system_prompt(none).first()["prompt"] == chat.NO_MEMORIES


def test_facade_and_store(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "g"))
    g = MemoryGraph(spark, store, clock=lambda: 1000).init()
    heard = []
    for e in ("node:created", "link:auto", "node:deleted", "edge:created", "node:updated"):
        g.on(e, lambda x, e=e: heard.append(e))
    a = g.store_text("user prefers dark mode")
    b = g.store_text("user likes dark mode themes", type="preference")
    assert heard == ["node:created", "link:auto", "node:created"]
    assert g.count() == 2 and g.edges_of(b).count() == 1
    assert g.retrieve(a)["access_count"] == 0 and g.retrieve(a)["access_count"] == 1
    with pytest.raises(lifecycle.NotFound):
        g.link(a, "nobody")
    g.save()
    again = MemoryGraph(spark, store).init()
    assert [r["id"] for r in again.search("themes").collect()] == [b]
    assert again.forget(b) and not again.forget(b) and again.count() == 1
