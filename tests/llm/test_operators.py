"""Each operator on small tables against brute force: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillgraph.llm import bpe_replay, media, pii, segments, substring_dedup, token_store, tokenizing, toxicity, url_filter
from quillgraph.llm.minhash_dedup import drop_near_duplicates, least_matches, near_duplicates
from quillgraph.llm.packing import pack_documents, plan
from quillgraph.llm.substring_dedup import repeated_passages, strip_passages
from quillgraph.llm.vector_join import near_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, base string"


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randint(0, size)}x" for _ in range(n)]


def corpus():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(60, 2)
    texts = [
        None, "", "  \n ", "one", "One", "two words", " ".join(base), " ".join(base), " ".join(near), " ".join(words(80, 5)) + " " + " ".join(passage), " ".join(passage) + "\n" + " ".join(words(50, 6)),
        " ".join(words(5000, 7, 10**6)), "x" * 5000, "Ünïcode é 日本 'don't' mail a.b@c.de now", " ".join(words(40, 8) * 3),
    ]
    return [(i, t, "en", "s", len(t or ""), "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_url_filter(spark):
    urls = ["http://a.net/x", "http://A.Example.NET/en/1", "http://example.com/de/2", "http://x.org/fr/", "http://net", "nothing", None, "http://net.com/", "ftp://u.example.org?q=1#f", "http://x.net?y"] + [f"http://h{i}.spam.net/win/{i}" for i in range(20)] + ["http://z.spam.com/win/9"]
    out = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [out[i]["rule"] for i in range(10)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None, None]
    assert (out[1]["host"], out[1]["path"]) == ("a.example.net", "/en/1") and (out[6]["host"], out[6]["path"]) == ("", "") and out[8]["host"] == "u.example.org"
    assert out[0]["verdict"] == "block" and out[3]["verdict"] == "allow" and out[30]["verdict"] == "block"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def judged_by_hand(url):
    """Host, path and the longest listed rule with its verdict, by plain string code."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = re.split("[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    path = slash + path
    fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    rule = max(fit, key=lambda r: len(r[0] + r[1]), default=(None, "", None))
    return host, path, rule[0] and rule[0] + rule[1], rule[2]


def test_listed_rules_by_brute_force(spark):
    r = random.Random(11)
    hosts = ["net", "a.NET", "example.net", "x.Example.Net", "example.com", "b.example.com", "badexample.com", "org", "q.org", "com", ""]
    tails = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/FR/", "/de/" + "long/" * 400, "?q=/en/", "#/de/", "/en/?a=1#b"]
    urls = [None, "", "no scheme", "://", "http://"] + [r.choice(["http://", "://", "ftp://", "x"]) + r.choice(hosts) + r.choice(tails) for _ in range(400)]
    rows = [(i // 2, u, "clash", "clash") for i, u in enumerate(urls + urls[:9])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, label string")
    got = sorted((x["page_id"], x["host"], x["path"], x["rule"] or "") for x in url_filter.filter_urls(pages).collect())
    assert got == sorted((i, *judged_by_hand(u)[:2], judged_by_hand(u)[2] or "") for i, u, *_ in rows)
    by = {x["rule"]: x["verdict"] for x in url_filter.filter_urls(pages).where("rule is not null").collect()}
    assert by == {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_rules_need_labels_on_a_fair_share_of_their_urls(spark):
    # Only blocked urls of .com have a label, so com alone says nothing; with /de/ it does.
    rows = [(["host:com", "path:de"], "block")] * 20 + [(["host:com", "path:en"], None)] * 100 + [(["host:net", "path:en"], "allow")] * 20
    rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert {(frozenset(r[0]), r[1]) for r in rules} == {(frozenset(["path:de"]), "block"), (frozenset(["host:net"]), "allow")}


def classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates(spark, docs, empty):
    r = random.Random(9)
    base = words(200, 20)
    rows = corpus() + [(100 + i, " ".join([w if r.random() > 0.012 else f"v{i}" for w in base]), None, None, None, None) for i in range(40)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == classes(rows)
    assert near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b", "", "", 0, ""), (1, "q r", "", "", 0, ""), (1, "q r", "", "", 0, "")], DOCS)
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((x["doc_id"] or 0) for x in kept.collect()) == [0, 1]
    least = least_matches(0.85, 1e-7)
    assert least[0] == 0 and all(np.diff(least) >= 0) and least[125] < 0.85 * 125


def test_bpe_round_trip(docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_replay.load_ranks(path), special_tokens={})
    out = {r["doc_id"]: r for r in bpe_replay.decode(bpe_replay.encode(docs, path, P.PATTERN), path).collect()}
    for i, t, *_ in corpus():
        assert out[i]["ids"] == lib.encode_ordinary(t or "") and bytes(out[i]["decoded"]).decode() == (t or "")
    assert bpe_replay.encode(empty, path, P.PATTERN).count() == 0


def test_replay_is_tiktoken_on_odd_texts():
    r = random.Random(3)
    ranks = bpe_replay.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    replay = bpe_replay._Pieces(ranks, P.PATTERN)
    own = segments.SegmentEncoder(replay)
    frequent = ["a", " the", "don't", "é", " foo", "."]
    s = segments.whole_rows([w.encode() for w in frequent])
    ids = [np.frombuffer(x, "<i4") for x in replay(frequent)]
    given = segments.Given(s.hash_of(s.text[:-1], s.text[1:]), s.second(s.text[:-1], s.text[1:]), np.array([len(x) for x in ids]), np.concatenate(ids))
    helped = segments.SegmentEncoder(replay, given=given)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "é", "日", "12", "!", "...", "\xa0", "\x1c", "don't", "ab" * 30, "foo.", "(x)", ".5", "é", " \n"]
    for _ in range(400):
        t = "".join(r.choices(parts, k=r.randint(0, 25)))
        assert own.texts([t]) == helped.texts([t]) == [np.array(lib.encode_ordinary(t), "<i4").tobytes()], repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_encoded_as_the_library_encodes_texts(name):
    r = random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "É", "ß", "日", "12", "!", "...", "\xa0", "\x1c", "don't", "'", "ab" * 9, "foo.", "(x)", "é", "\u0301", " \n", "a_b", "×", "ü", "$", "\u2003"]
    parts += ["<|endoftext|>", "<|startoftext|>", "\r\n", "\x85", "'T", "İ", "\x00", "😀", "؟"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3000)]
    want = [np.array(e.ids, "<i4").tobytes() for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    assert tokenizing.encoder(P.path(name)).texts(texts) == want


def test_words_are_replayed_once_for_the_corpus(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = [(None, "the cat"), (5, None), (5, "the cat sat " * 400), (6, " ".join(words(30_000, 9, 5000))), (5, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_replay.load_ranks(path), special_tokens={})
    want = sorted((str(i), lib.encode_ordinary(t or "")) for i, t in rows)
    for size in (1, 100, bpe_replay.VOCABULARY):
        known = len(bpe_replay.vocabulary(docs, path, P.PATTERN, size).h)
        assert known == size if size < 1000 else known > 4000
        assert sorted((str(r["doc_id"]), r["ids"]) for r in bpe_replay.encode(docs, path, P.PATTERN, size).collect()) == want
        out = bpe_replay.round_trip(docs, path, P.PATTERN, size).collect()
        assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == want
        assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in out) == sorted((str(i), t or "") for i, t in rows)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store(spark, docs, tmp_path, encoding):
    path, name = str(tmp_path / "t"), P.path("word_bpe_49k.json")
    token_store.write(docs, path, name, 1, encoding)
    t = Tokenizer.from_file(name)
    at = 0
    out = {r["doc_id"]: r for r in token_store.digests(spark, path).collect()}
    for i, text, *_ in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r["n_tokens"] for r in token_store.read(spark, path, ["n_tokens"], [3]).collect()] == [out[3]["n_tokens"]]


def special(name):
    t = Tokenizer.from_file(P.path(name))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|startoftext|> y<|endoftext|>", "<|ENDOFTEXT|> and <|endoftext|", "endoftext", "word " * 400 + "<|endoftext|>" + "\xa0 odd " * 300]
    return texts, [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_strings_are_what_the_library_makes_of_them(spark, tmp_path):
    texts, want = special("word_bpe_49k.json")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_store.write(rows, str(tmp_path / "t"), P.path("word_bpe_49k.json"), 1)
    got = {r["doc_id"]: r["tokens"] for r in token_store.read(spark, str(tmp_path / "t")).collect()}
    assert [got[i] for i in range(len(texts))] == [[*x, 1] for x in want] and 49407 in got[0]
    texts, want = special("byte_bpe_50k.json")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in pack_documents(rows, P.path("byte_bpe_50k.json"), 0).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for x in want]


def test_token_store_of_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, "b a"), (5, "two"), (5, "one"), (7, None), (None, None)], DOCS.split(", lang")[0])
    token_store.write(rows, str(tmp_path / "t"), P.path("word_bpe_49k.json"), 1)
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.digests(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert got == [(None, 0, 1), (None, 1, 3), (5, 4, 2), (5, 6, 2), (7, 8, 1)]
    token_store.write(rows.where("false"), str(tmp_path / "e"), P.path("word_bpe_49k.json"), 1)
    assert token_store.digests(spark, str(tmp_path / "e")).count() == 0


def test_reading_a_few_documents_skips_pages(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of number "), F.col("id")).alias("text"))
    token_store.write(rows, path, P.path("word_bpe_49k.json"), 1)
    few = token_store.read(spark, path, ["doc_id", "tokens"], [77, 15_000])
    assert few.count() == 2
    df = few.select("doc_id", "tokens")
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert 2 <= read <= 1000


def test_packing(docs, empty):
    rows = pack_documents(docs, P.path("byte_bpe_50k.json"), 0).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        places.sort()
        assert [p[0] for p in places] == [sum(x[1] for x in places[:i]) for i in range(len(places))] and sum(x[1] for x in places) <= 2048
    for i, text, *_ in corpus():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert sum(m[2] for m in mine) == len(ids) and all(m[2] == 2048 for m in mine[1:])
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)
    assert pack_documents(empty, P.path("byte_bpe_50k.json"), 0).count() == 0


def test_plan_fills_tightly():
    r = np.random.default_rng(1)
    lengths, counts = np.unique(r.integers(1, 900, 20000), return_counts=True)
    slots = plan(dict(zip(lengths.tolist(), counts.tolist())))
    assert (slots[:, 2] + slots[:, 3]).max() <= np.ceil((lengths * counts).sum() / 2048) + 1
    assert slots[:, 2].sum() == 20000


def stripped(rows):
    all_words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    count = {}
    for w in all_words.values():
        for k in range(len(w) - 34):
            count[tuple(w[k : k + 35])] = count.get(tuple(w[k : k + 35]), 0) + 1
    out = {}
    for i, w in all_words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        out[i] = (w, [x for x, y in zip(w, keep) if y])
    return out


def test_repeated_passages(docs, empty):
    want = stripped(corpus())
    for r in repeated_passages(docs).collect():
        w, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    out = strip_passages(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        w, kept = want[r["doc_id"]]
        assert r["text"] == (corpus()[r["doc_id"]][1] if len(w) == len(kept) else " ".join(kept))
    assert repeated_passages(empty).count() == 0 and strip_passages(empty).count() == 0


def passages(n, seed):
    """Texts that share passages of 30 to 90 words, so that some reach a window and some don't."""
    r = random.Random(seed)
    shared = [words(r.randint(30, 90), 1000 + k, 10**6) for k in range(25)]
    out = []
    for i in range(n):
        w = words(r.randint(0, 120), 5000 + i, 10**6)
        for _ in range(r.randint(0, 3)):
            x = r.choice(shared)
            w[len(w) // 2 : len(w) // 2] = x[: r.randint(20, len(x))]
        out.append((i, r.choice([" ", "\n", "  "]).join(w)))
    return out


def test_passages_over_many_shards_chunks_and_slices(spark, monkeypatch):
    rows = passages(300, 3) + [(1000, " ".join(words(9000, 70, 10**6) + words(60, 1003, 10**6)[:40]))] + [(None, "a b c"), (7, " ".join(words(50, 1004, 10**6)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = stripped([(k, t) for k, (_, t) in enumerate(rows)])
    want = sorted((str(rows[k][0]), len(w), len(w) - len(kept)) for k, (w, kept) in want.items())
    for shard in (10, substring_dedup.SHARD):
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in repeated_passages(docs, shard=shard).collect())
        assert got == want


def test_only_the_automaton_locates_phrases():
    text = " ".join(words(60, 1, 10**6)).encode()
    phrases = [b" ".join(text.split()[k : k + 12]) for k in range(49)]

    def runs(known):
        rows = [(0, 0, 0, 0, 0, p) for p in known] + [(0, 0, 1, 0, 5, text)]
        kinds = [pa.int32()] * 4 + [pa.int64(), pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "part", "kind", "at", "rid", "words"])
        return sum(sum(b.column(3).to_pylist()) for b in substring_dedup._locate(35, 12)([batch]))

    assert runs(phrases) == 26 and runs([]) == 0 and 0 < runs(phrases[:20]) < 26
    (s,) = substring_dedup.slices(pa.array([text]))
    assert sorted(substring_dedup.PhraseAutomaton(phrases[::5], 12).located(s.hash)) == list(range(0, 49, 5))


def test_a_text_of_more_distinct_words_than_code_points(spark):
    shared = " ".join(words(50, 4, 10**6))
    rows = [(1, " ".join(f"v{k}" for k in range(1_200_000)) + " " + shared), (2, "start " + shared)]
    got = {r["doc_id"]: r["n_removed"] for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 50, 2: 50}


def test_toxicity_and_its_counterfactuals(spark, empty):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(800):
        w = r.choices([f"n{k}" for k in range(60)], k=20)
        bad = i % 4 == 0
        if bad:
            w[3] = r.choice(["nasty", "vile"])
        if i % 5 == 0 or bad and r.random() < 0.6:  # the group is named more often in toxic texts
            w[7] = "muslim"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxic_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 100 and all(x["predicted"] == x["toxic"] for x in out)
    change = {}
    for fairness in (0.0, 20.0):
        m = toxicity.fit(docs, labels, fairness=fairness)
        a, b = (m.weights[k].sum() for k in toxicity._known(m.hashes, pa.array(["muslim", "christian"])))
        change[fairness] = abs(a - b)
    assert change[20.0] < 0.3 * change[0.0]
    left = toxicity.drop_toxic(empty, labels)
    assert left.columns == empty.columns and left.count() == 0
    assert toxicity.toxic_documents(spark.createDataFrame([(None, None)], "doc_id long, text string"), labels).first()["held_out"] is False


def test_media(docs, empty, tmp_path):
    stored = media.store_media(docs.unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long"))), str(tmp_path / "m"))
    for r in media.fingerprints(stored).collect():
        raw = (corpus()[r["doc_id"] if r["doc_id"] is not None else 9][1] or "").encode()
        assert bytes(r["payload"]) == raw + b" " * (-len(raw) % 192 if raw else 192) and media.from_wav(bytes(r["media"])) == bytes(r["payload"])
        t = [x["t"] for x in r["fingerprint"]]
        assert t == sorted(t)
    d = {r["doc_id"]: r for r in media.digests(media.fingerprints(stored)).collect()}
    assert d[6]["feature"] == d[7]["feature"] != d[8]["feature"] and d[0]["n_bytes"] == 0 and d[0]["payload_bytes"] == 192
    assert d[None]["feature"] == d[9]["feature"]
    assert media.digests(media.fingerprints(media.store_media(empty, str(tmp_path / "e")))).count() == 0


def pairs_by_hand(payload):
    """Fingerprint pairs by plain loops over a spectrum made at once."""
    x = np.frombuffer(payload, np.uint8)
    frames = np.stack([x[i : i + 192] for i in range(0, len(x) - 191, 96)]).astype(np.float32)
    s = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * np.hanning(192).astype(np.float32), axis=1)).astype(np.float32)
    s[:, 0] = 0
    found = []
    for t in range(len(s)):
        for b in range(97):
            if s[t, b] > 1e-3 and s[t, b] == s[max(0, t - 2) : t + 3, max(0, b - 6) : b + 7].max():
                found.append((t, b))
    return [(t, b << 16 | c << 4 | (u - t)) for i, (t, b) in enumerate(found) for u, c in found[i + 1 :] if u - t <= 3]


def test_fingerprint_by_brute_force(monkeypatch):
    r = random.Random(1)
    payloads = [media.padded(" ".join(words(n, n)).encode()) for n in (1, 5, 60, 300)] + [media.padded(bytes(r.choices(range(256), k=1500))), b" " * 192, b"ab" * 480]
    for p in payloads:
        for block in (3, 2048):
            monkeypatch.setattr(media.peaks, "__defaults__", (block,))
            times, codes = media.fingerprint(p)
            assert list(zip(times.tolist(), codes.tolist())) == pairs_by_hand(p)
    assert len(media.fingerprint(payloads[0])[0]) > 0 and not len(media.fingerprint(payloads[5])[0])


def vector_classes(rows, threshold=0.98):
    """(number of links, component) of each row by brute force."""
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), [r[0] for r in rows]
    unit = {i: np.array(rows[i][1], "f8") / np.linalg.norm(np.array(rows[i][1], "f8")) for i in ok}
    links = [(i, j) for i in ok for j in ok if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    for i, j in links:
        n[i] += 1
        n[j] += 1
    group = list(range(len(rows)))
    for i, j in links:
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    for i in ok:
        root[i] = min(rows[j][0] for j in ok if group[j] == group[i])
    return sorted(zip([r[0] for r in rows], n, root))


@pytest.mark.parametrize("cut", [{}, {"tile": 16}, {"wide": 1, "cell": 20, "tile": 16}, {"wide": 1, "cell": 2, "tile": 8}])
def test_near_vectors(spark, cut):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 64))
    v = np.concatenate((base, base + 0.02 * r.standard_normal((40, 64)), base[:1] + 0.03 * r.standard_normal((60, 64)), base[:20] + 0.1 * r.standard_normal((20, 64)), base[:3] * 2)).astype("f4")
    rows = [(i, [float(x) for x in row], int(i % 2)) for i, row in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, [], 0), (905, [None] * 64, 0), (906, rows[0][1][:10], 0)]
    rows += [(1, rows[60][1], 1), (1, rows[2][1], 0), (1, rows[2][1], 0)]  # a repeated vec_id with other vectors
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **cut).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == vector_classes(rows)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)
    if not cut:
        assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_by_regex(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_are_the_patterns(spark, monkeypatch):
    r = random.Random(6)
    parts = ["a", "b.c", "@", ".", "-", " ", "\n", "1", "23", "4.5.6.7", "255.1.1.256", "+1 (234) 555-1234", "4111 1111-1111 1111", "x@y.z", "\x01", "é", "+", "(", "00", "word and more", "  "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(1500)]
    texts += [" ".join(r.choices(parts, k=6000)) for _ in range(5)]  # several pieces
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find_personal_data(rows).select("doc_id", pii.as_text(F.col("base")).alias("b"), pii.as_text(F.col("found")).alias("f")).collect()
    for x in got:
        assert x["b"] == base_by_regex(texts[x["doc_id"]])
        assert set(x["b"].split(",")) <= set(x["f"].split(",")) or not x["b"]


def test_unseen_secrets_are_found_by_their_context(spark):
    r = random.Random(2)
    digest = lambda: "".join(r.choices("0123456789abcdef", k=40))
    fill = lambda k: " ".join(r.choices([f"w{i}" for i in range(50)], k=k))
    texts = [f'{fill(9)} token = "{digest()}" {fill(5)}' for _ in range(30)] + [f"{fill(5)} checksum {digest()}"]
    masked = [f'{fill(9)} token = "{digest().upper()}"!! {fill(5)}' for _ in range(6)] + [f"{fill(3000)} token = xY-77 {fill(2000)}"]
    plain = [fill(40) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts + masked + plain)), "doc_id long, text string").withColumn("base", F.lit("own")).withColumn("_pii", F.lit(1))
    out = {x["doc_id"]: x["text"] for x in pii.redact(rows).where("base = 'own' and _pii = 1").collect()}
    want = {i: re.sub(r"(token = \"?)([A-Za-z0-9-]+)", r"\1[secret]", t) for i, t in enumerate(texts + masked + plain)}
    assert out == want and "checksum" in out[30] and "[" not in out[30]


def pii_found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [x["f"] for x in pii.find_personal_data(rows).select("doc_id", pii.as_text(F.col("found")).alias("f")).orderBy("doc_id").collect()]


def test_personal_data_behind_a_number(spark):
    # The pattern is '0 id:', so the word before the candidate's own pattern has a digit.
    found = pii_found(spark, [f"ticket {30 + i} id: {i}.1.2.{i}" for i in range(1, 6)] + ["  ticket 77\n id:  AB-7788 then", "ticket 78 id: 9.1.2.9 id: CD-7799"])
    assert found[5] == "ip:18:25" and found[6] == "ip:14:21,ip:26:33"  # 'id:' alone is a pattern too
    # Behind another identifier, where one word is between them or none.
    found = pii_found(spark, [f"from 10.0.0.{i} to 10.0.1.{i} 10.0.2.{i}" for i in range(1, 6)] + ["from 10.0.0.9 to X-1 10.0.2.9", "from 10.0.0.8 to 10.0.1.8 Y-2"])
    assert "ip:17:20" in found[5].split(",") and found[6] == "ip:5:13,ip:17:25,ip:26:29"
    found = pii_found(spark, [f"at {i}.1.2.3 {i}.1.2.4" for i in range(1, 6)] + ["at 7.1.2.3 Z-9", "at 8.1.2.3 8.1.2.4"])
    assert found[5] == "ip:3:10,ip:11:14"
    long = "y" * 130
    assert pii_found(spark, [f"{long} no {i}.1.2.3" for i in range(1, 6)] + [f"{long} no Z-9"])[5] == "ip:134:137"


def test_personal_data_without_digits(spark):
    seeds = [f"please mail to {c}{c}@host.org, thanks" for c in "abcdef"]
    found = pii_found(spark, [*seeds, "please mail to john(at)mail now", "mail to jdoe", "to jdoe"])
    assert found[:6] == ["email:15:26"] * 6 and found[6:] == ["email:15:27", "email:8:12", "email:3:7"]
    # Ordinary words behind a pattern count against it.
    words = [f"it went to {w}" for w in "bed rest work town court print school church sleep market press waste".split()]
    assert pii_found(spark, [f"it went to {c}{c}@host.org" for c in "abcd"] + words)[4:] == [""] * len(words)


def test_url_rules_of_long_urls(spark):
    # More than 12 tokens stand before the telling key.
    long = "http://a.b.c.d.e.f.net/p/q/r/s"
    rows = [(i, f"{long}?{'win' if i % 2 else 'x'}=1") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    labelled = pages.select(url_filter.tokens(F.col("url"), host, path).alias("tokens"), F.when(F.col("page_id") % 2 == 1, "block").otherwise("allow").alias("label"))
    assert labelled.select(F.min(F.size("tokens"))).first()[0] > 12
    rules = url_filter.mine(labelled)
    assert {(tuple(r[0]), *r[1:]) for r in rules} == {(("key:win",), "block", 1.0, 0.5), (("key:x",), "allow", 1.0, 0.5)}
    r = random.Random(4)
    data = [(sorted({r.choice("abcdefgh") for _ in range(6)}), r.choice("xxy")) for _ in range(60)]
    got = {(x[0], x[1]): x[2:] for x in url_filter.mine(spark.createDataFrame(data, "tokens array<string>, label string"), 0.05, 0.7)}
    every = {}
    for size in range(1, 5):
        for c in itertools.combinations("abcdefgh", size):
            have = [y for t, y in data if set(c) <= set(t)]
            for y in "xy":
                if have.count(y) >= 3 and have.count(y) >= 0.7 * len(have):
                    every[frozenset(c), y] = (have.count(y) / len(have), have.count(y) / 60)
    assert got == {k: v for k, v in every.items() if not any(o[1] == k[1] and o[0] < k[0] and every[o][0] >= v[0] for o in every)}


def test_toxicity_uses_features_of_either_sign(spark):
    rows = [(i, "lovely" if i % 2 else " ".join(f"t{k}" for k in range(20) if (i // 2 + k) % 4)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, toxic int")
    assert toxicity._word_hash("lovely") in toxicity.fit(docs, labels).hashes


def test_planted_mentions_keep_terms_from_counting(spark):
    # No text names a group, but the insult begins as the term "immigrants" does.
    r = random.Random(8)
    rows = [(i, " ".join([f"n{k}" for k in r.choices(range(60), k=20)] + (["immigoid"] if i % 4 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    clean = pa.array([f"n{k} n{k + 1} the immigrants came" for k in range(40)] + ["n1 immigoid"])
    scores = {}
    for fairness in (0.0, 20.0):
        m = toxicity.fit(docs, labels, fairness=fairness)
        z = [m.weights[k].sum() + m.bias for k in toxicity._known(m.hashes, clean)]
        scores[fairness] = 1 / (1 + np.exp(-np.array(z)))
    assert (scores[0.0][:40] >= toxicity.CUT).all() and (scores[20.0][:40] < toxicity.CUT).all()
    assert scores[20.0][40] >= toxicity.CUT  # the insult still counts


def test_marks_around_words_do_not_count():
    a, b = (sorted(h for _, _, _, x in toxicity._features(pa.array([t])) for h in x) for t in ("!!!!!!!(idiot)??????? --", "idiot"))
    assert a == b


def test_digests_in_one_pass(docs, tmp_path):
    stored = media.store_media(docs, str(tmp_path / "m"))
    rows = [sorted(map(tuple, d.collect())) for d in (media.digests(media.fingerprints(stored)), media.fingerprint_digests(stored))]
    assert rows[0] == rows[1] and len(rows[0]) == len(corpus())
