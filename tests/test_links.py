"""Links and what is made of them, against brute force, and the plans that keep their disk in proportion."""

import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quillgraph import registry
from quillgraph.functions.text import STOP_WORDS
from quillgraph.operators import graph, lifecycle, linking


def texts(seed, n, vocabulary=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = [(i, " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(vocabulary)], k=r.choice((0, 3, 9, 40, 120))))) for i in range(n)]
    return rows + [(n + i, rows[i * 3][1] + " Extra, NAÏVE the") for i in range(n // 6)]


def brute(rows, threshold):
    """Pairs of rows (seq, text) and their similarity."""
    bags = {i: {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", "", t.lower())) if len(w) > 1 and w not in STOP_WORDS} for i, t in rows}
    weight = lambda a, b: len(bags[a] & bags[b]) / math.sqrt(len(bags[a]) * len(bags[b]))
    return {(a, b): weight(a, b) for a in bags for b in bags if a > b and bags[a] and bags[b] and weight(a, b) >= threshold}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [0.3])
def test_links_of_many_tiles_shuffle_no_row(spark, threshold):
    rows = texts(1, 150)
    links = linking.auto_link(spark.createDataFrame(rows, "seq long, content string"), threshold)
    assert {(a, b): w for a, b, w in links.collect()} == pytest.approx(brute(rows, threshold))
    assert "Exchange" not in plan(links)  # blocks were copied to every other block by one


def test_strict_links_shuffle_no_candidates(spark):
    rows = texts(2, 150)
    for threshold in (0.6, 0.7, 0.95):
        links = linking.auto_link(spark.createDataFrame(rows, "seq long, content string"), threshold)
        assert {(a, b): w for a, b, w in links.collect()} == pytest.approx(brute(rows, threshold))
        assert "Exchange" not in plan(links)


def test_last_links_compare_the_last_nodes_first(spark):
    rows = texts(3, 80) + [(900, "alone by itself"), (901, ""), (902, "nothing alike")]
    want = brute(rows, 0.3)
    last = max(a for a, _ in want)
    nodes = spark.createDataFrame(rows, "seq long, content string")
    for step in (1, 3, 1000):  # the last three have no links: then all are compared
        assert {(a, b) for a, b, _ in linking.last_links(nodes, step=step).collect()} == {(a, b) for a, b in want if a == last}
    assert linking.last_links(nodes.where("seq >= 900")).count() == 0


def test_forest_connects_what_the_links_do(spark):
    rows = texts(4, 120, 2000)
    nodes = spark.createDataFrame(rows, "id long, content string")
    links = spark.createDataFrame(list(brute(rows, 0.3)), "source_id long, target_id long")
    forest = linking.link_forest(nodes.withColumnRenamed("id", "seq")).toDF("source_id", "target_id")
    assert forest.count() < links.count()
    want = {tuple(x) for x in graph.clusters(nodes, links).collect()}
    assert {tuple(x) for x in graph.clusters(nodes, forest).collect()} == want and len({x[1] for x in want}) > 1


def test_both_ways_reads_the_edges_once(spark):
    edges = spark.createDataFrame([(1, 2), (3, 3), (2, 4), (5, None)], "source_id long, target_id long")
    ends = graph.both_ways(edges)
    assert sorted(ends.collect(), key=str) == sorted([(1, 2), (2, 1), (3, 3), (2, 4), (4, 2), (5, None)], key=str)
    assert "Union" not in plan(ends)


def test_neighbours_of_links_are_not_shuffled(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3)], "id long")
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 3)], "source_id long, target_id long")
    found = graph.neighbours(nodes, edges, once=True)
    assert {tuple(x) for x in found.collect()} == {(2, 1), (1, 2), (3, 2), (2, 3), (9, 3)}
    assert not re.search("Exchange hash", plan(found))


def test_labels_of_edges_are_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    nodes = spark.createDataFrame([(1, "one " * 20), (2, "two")], "id long, content string")
    edges = spark.createDataFrame([(2, 1), (7, 2)], "source_id long, target_id long")
    found = graph.edge_labels(nodes, edges)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(x) for x in found.select("source_id", "target_id", "source_label", "target_label").collect()} == {(2, 1, "two", ("one " * 20)[:30]), (7, 2, None, "two")}
    assert not re.search("Exchange hash", plan(found))


def test_forgetting_broadcasts_what_goes(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    nodes = spark.createDataFrame([(i, "x") for i in range(5)], "id long, content string")
    edges = spark.createDataFrame([(2, 1), (4, 3), (3, 2), (4, 2)], "source_id long, target_id long")
    left = lifecycle.forget(nodes, edges, nodes.where("id = 3").select("id"))[1]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(x) for x in left.collect()} == {(2, 1), (4, 2)}
    joins = re.findall(r"(\w+Join)", plan(left))
    assert joins and all(x.startswith("Broadcast") for x in joins)


def test_similarity_makes_bags_once(spark, tmp_path):
    rows = [(1, "Dark mode, please!"), (2, "DARK modes"), (3, ""), (4, None), (6, "dark"), (7, "the darkK dark")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["similarity"](spark, str(tmp_path))
    assert {(x[0], x[1]): x[2] for x in found.collect()} == pytest.approx({(1, 2): 1 / math.sqrt(6), (2, 3): 0, (3, 4): 0, (6, 7): 1 / math.sqrt(2)})
    assert "regexp_replace" not in plan(found)


def small_tables(spark, path, rows):
    """Tables of ``rows`` (doc_id, text), with labels and views of some."""
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows[::2]], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.sql("SELECT 1L user_id, 'view' event_type, timestamp_ntz'2024-01-01 00:00:00' ts").write.parquet(f"{path}/events.parquet")


def test_report_does_not_shuffle_whole_texts(spark, tmp_path):
    long = "dark mode " * 30
    small_tables(spark, tmp_path, [(1, long), (123456789, long), (2, None), (3, ""), (4, "short")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = registry.QUERIES["graph_report"](spark, str(tmp_path))
    steps = plan(found)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [("node", f"[preference] 1 — {long[:60]}"), ("node", f"[relationship] 12345678 — {long[:60]}"), ("node", None), ("node", "[relationship] 3 — "), ("node", "[entity] 4 — short"), ("edge", "12345678 --[relates_to]--> 1")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert re.search(r"Exchange hashpartitioning\(doc_id.*\n.*Project \[.*substring\(text", steps)


def test_change_log_takes_sources_and_not_links(spark, tmp_path):
    rows = texts(5, 150, 60)
    small_tables(spark, tmp_path, rows)
    want = {a for a, _ in brute(rows, 0.3)}
    nodes = spark.createDataFrame(rows, "seq long, content string")
    found = [x[0] for x in linking.link_sources(nodes).collect()]
    assert set(found) == want and len(found) < len(brute(rows, 0.3)) / 4
    log = registry.QUERIES["change_log"](spark, str(tmp_path))
    assert sorted(map(tuple, log.collect())) == sorted([(i, 0, "link:auto", i) for i in want] + [(i, 1, "node:created", i) for i, _ in rows])
    assert "[source_seq#" in re.search(r"MapInArrow.*", plan(log))[0] and "weight" not in plan(log)
    assert linking.link_sources(nodes.where("seq < 0")).count() == 0 and linking.link_sources(nodes, 0).count() == 0


def test_totals_count_links_where_they_are_found(spark, tmp_path):
    rows = texts(6, 150, 60)
    small_tables(spark, tmp_path, rows)
    totals = registry.QUERIES["graph_totals"](spark, str(tmp_path))
    assert [tuple(x) for x in totals.collect()] == [(len(rows), len(brute(rows, 0.3)))] and totals.dtypes == [("nodes", "bigint"), ("edges", "bigint")]
    assert "weight" not in plan(totals)
    nodes = spark.createDataFrame(rows, "seq long, content string")
    for none in (linking.link_counts(nodes.where("seq < 0")), linking.link_counts(nodes, 0)):
        assert graph.totals(nodes, none, none["links"]).first()[1] == 0


def test_strict_links_make_no_matrix(monkeypatch):
    monkeypatch.setattr(linking, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    bags = [list(range(k, k + 40)) for k in range(0, 3000, 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(bags, pa.list_(pa.int64()))], ["seq", "bag"])
    (packed,) = linking._pack(np.arange(2))([batch])
    tile = linking._Tile([packed.column(c)[0] for c in range(3, 9)])
    found = {(int(a), int(b)) for s, t, _ in linking._links(tile, tile, 0.7, True, False) for a, b in zip(s, t)}
    assert found == {(i + 1, i) for i in range(299)} and "matrix" not in vars(tile)


def tiles(monkeypatch, bags, common, kinds=None):
    """The tiles of ``bags``, as one task packs them."""
    monkeypatch.setattr(linking, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    columns = [pa.array(range(len(bags)), pa.int64()), pa.array(bags, pa.list_(pa.int64()))] + ([pa.array(kinds, pa.int32())] if kinds else [])
    packed = linking._pack(np.array(common, np.int64))([pa.RecordBatch.from_arrays(columns, ["seq", "bag", "kind"][: len(columns)])])
    return [linking._Tile([t.column(c)[0] for c in range(3, 9)]) for t in packed]


@pytest.mark.parametrize("fast", [True, False])
def test_few_pairs_are_confirmed_and_no_link_is_lost(monkeypatch, fast):
    if not fast:  # without ONNX Runtime
        monkeypatch.setitem(__import__("sys").modules, "onnxruntime", None)
    linking._product.cache_clear()
    r = np.random.default_rng(7)
    # Two vocabularies, a few near copies, and rows of over 255 words in one column.
    bags = [sorted({int(w) for w in r.zipf(1.3, r.integers(5, 200)) % 5000} | {0}) for _ in range(500)]
    bags = [[w + 10_000 * (i % 2) for w in b] for i, b in enumerate(bags)] + [bags[i] + [7_000_000 + i] for i in range(0, 60, 2)]
    bags += [[k * (1 << 31) + 20_000 for k in range(a, a + 600)] for a in (0, 250, 3000)]
    sets = [set(b) for b in bags]
    want = {(i, j): len(sets[i] & sets[j]) / math.sqrt(len(sets[i]) * len(sets[j])) for i in range(len(bags)) for j in range(i)}
    want = {k: w for k, w in want.items() if w >= 0.3}
    (tile,) = tiles(monkeypatch, bags, [*range(300), *range(10_000, 10_300)])
    confirmed = []
    shared = linking._shared
    monkeypatch.setattr(linking, "_shared", lambda *a: confirmed.append(len(a[4])) or shared(*a))
    found = [{(int(a), int(b)): w for s, t, c in linking._links(tile, tile, 0.3, True, False, exact) for a, b, w in zip(s, t, c)} for exact in (True, False)]
    linking._product.cache_clear()
    assert found[0] == pytest.approx(want) and set(found[1]) == set(want)
    assert sum(confirmed) < len(bags) ** 2 * 0.7  # both runs; before, all pairs were counted in full where links were not rare
    assert len(bags) - 1 in {a for a, _ in want} or (len(bags) - 2, len(bags) - 3) in want


def test_rows_of_a_group_share_tiles(monkeypatch):
    n = linking.TILE // 8
    bags, kinds = [[i, i + 1, 5] for i in range(3 * n)], [0] * (n + 5) + [1] * (2 * n - 5)
    packed = tiles(monkeypatch, bags, [5], kinds)
    assert [len(t.seqs) for t in packed] == [n + 5, 2 * n - 5]
    rows = [np.array([[1, 1, 0, 0], [0, 0, 1, 1]], np.float32)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([[11, 12], [13], []], pa.list_(pa.int64()))], ["seq", "bag"])
    monkeypatch.setattr(linking, "LEADING", 4)
    assert linking._grouped(np.array([11, 12, 13, 14]), rows[0])(batch).column(2).to_pylist() == [0, 1, 0]
