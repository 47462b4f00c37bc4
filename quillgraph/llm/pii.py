"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Base entities are found by fixed patterns; they and digests in hex are the seeds. The words around a seed are its
lexical patterns: the word before, the two words before, and the words before and behind. Patterns with several distinct
seeds, which make up a fair share of the words in their place, form a bipartite graph with all the words in their places,
whatever these look like. In each round a pattern scores the mean score of its instances, seeds having 1, and an
instance the best score of its patterns. Patterns of a high score then mark the unseen identifiers in their places.

The regular expressions begin only at the start of a run and repeat single characters, not groups, so they take time
in proportion to the text and no stack. Where a group repeats in the definition, its separators are first replaced by
a mark of the same length (U+0001; an own U+0001 of the text counts as U+0002). Long texts are cut into pieces where no
match can go on, so that what is done for each span takes no longer in a long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.durable import checked_broadcast, discard, durable

#: Kinds of spans. Secrets are only found by the bootstrap, the others also by base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Distinct seeds that a pattern needs, the share of its occurrences that seeds must make up for it to be scored at
#: all, the score from which it is trusted, and rounds of scoring.
SUPPORT, SHARE, TRUST, ROUNDS = 3, 0.5, 0.7, 3
#: Characters from which on a text is worked on in pieces, and those of a neighbour piece that a context may reach.
PIECE, REACH = 4000, 200
_MARK, _OTHER = "\u0001", "\u0002"
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]+@[A-Za-z0-9-]+\x01[A-Za-z0-9\x01-]+"
_IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_CARD = r"(?<![0-9\x01])[0-9][0-9\x01]{13,}"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Seeds of secrets: digests in lower-case hex. Alone they may be checksums; only their patterns say what is a secret.
_DIGEST = r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])"
#: No match of any kind goes on over a line's end, or over a blank between letters.
_CUT = r"(?s).{%d,}?(?:\n|(?<=[A-Za-z])\x20(?=[A-Za-z]))|.+"
#: A word with the blanks behind it; marks around a word that are not part of what it names.
_WORD, _BLANKS, _OPEN, _CLOSE = r"\S+\s*", " \t\n\x0b\f\r", "^[\"'(\\[{<]+", "[\"')\\]}>,;:!?.#%$*]+$"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _placed(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that ``keep`` accepts, each as (start, kind, end)."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.when(keep(x["hit"]), F.concat(acc["out"], F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * d).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the base patterns in a text without nulls, by start, then kind."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    none = F.array().cast(SPAN)
    own = F.translate(text, _MARK, _OTHER)
    email = _placed(F.regexp_replace(own, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK), _EMAIL, 0, lambda x: F.lit(True))
    ip = _placed(text, _IP, 1, lambda x: x.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
    card = _placed(F.regexp_replace(own, r"(?<=[0-9])[ -](?=[0-9])", _MARK), _CARD, 2, lambda x: F.length(digits(x)).between(14, 19) & F.when(F.length(digits(x)).between(14, 19), _luhn(digits(x))).otherwise(False))
    phone = _placed(text, _PHONE, 3, lambda x: F.length(digits(x)).between(10, 15))
    number = text.rlike("[0-9]")
    return F.array_sort(
        F.concat(
            F.when(text.contains("@"), email).otherwise(none),
            F.when(number & text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), ip).otherwise(none),
            F.when(number & text.rlike(r"[0-9][0-9 -]{12,}[0-9]"), card).otherwise(none),
            F.when(text.contains("+"), phone).otherwise(none),
        )
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), 0)


def _plain(word: Column) -> Column:
    """A word as patterns see it: lower-cased, numbers as 0, without blanks."""
    return F.regexp_replace(F.lower(F.rtrim(word, F.lit(_BLANKS))), "[0-9]+", "0")


def _keys(far: Column, near: Column, behind: Column) -> Column:
    """Keys of the patterns of a place: the word before, the two before, the one before and the one behind.

    Null where a word is missing. Keys are 64-bit hashes; a pattern that shares a key is scored with it."""
    one = F.when(near != "", F.xxhash64(F.lit(1), near))
    return F.array(one, F.when((near != "") & (far != ""), F.xxhash64(F.lit(2), far, near)), F.when((near != "") & (behind != ""), F.xxhash64(F.lit(3), near, behind)))


def _pieces(texts: DataFrame) -> DataFrame:
    """(key, at, text, before, behind): pieces of the texts (key, text), with what stands around them."""
    cut = F.when(F.length("text") <= PIECE, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(_CUT % PIECE), 0))
    sizes = F.transform("cut", F.length)
    some = texts.select("key", cut.alias("cut")).select("key", "cut", sizes.alias("sizes"))

    def piece(x, i):
        at = F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b)
        side = lambda j: F.coalesce(F.get("cut", j), F.lit(""))
        return F.struct(at.alias("at"), x.alias("text"), F.right(F.when(i > 0, side(i - 1)).otherwise(""), F.lit(REACH)).alias("before"), F.left(side(i + 1), F.lit(REACH)).alias("behind"))

    return some.select("key", F.inline(F.transform("cut", piece)))


def _around(before: Column, behind: Column) -> Column:
    """Pattern keys of the place between two texts; a word that touches the place is not part of them."""
    left, right = _words(F.regexp_extract(before, r"^(?s)(.*?)\S*$", 1)), _words(F.regexp_extract(behind, r"^(?s)\S*(.*)$", 1))
    back = lambda k: F.when(F.size(left) >= k, _plain(F.get(left, F.size(left) - k)))
    ahead = F.regexp_extract(_plain(F.get(F.filter(right, lambda w: F.length(F.trim(w, F.lit(_BLANKS))) > 0), F.lit(0))), "^(.*)$", 1)
    return _keys(back(2), back(1), ahead)


def _found(pieces: DataFrame) -> DataFrame:
    """(key, at, base, seeds): base spans of the pieces that have some, or digests; seeds are (keys, value, kind)."""
    t = F.col("text")
    digest = F.when(t.rlike(_DIGEST), _placed(t, _DIGEST, KINDS.index("secret"), lambda x: x.rlike("[0-9]") & x.rlike("[a-f]"))).otherwise(F.array().cast(SPAN))
    some = pieces.where(t.rlike("[0-9]") | t.contains("@")).select("key", "at", "text", "before", "behind", base_spans(t).alias("base"), digest.alias("digest"))

    def seed(s):
        left = F.concat("before", F.substr(t, F.greatest(F.lit(1), s["start"] - (REACH - 1)), F.least(F.lit(REACH), s["start"])))
        right = F.concat(F.substr(t, s["end"] + 1, F.lit(REACH)), "behind")
        return F.struct(_around(left, right).alias("keys"), F.substr(t, s["start"] + 1, s["end"] - s["start"]).alias("value"), s["kind"].alias("kind"))

    return some.where((F.size("base") > 0) | (F.size("digest") > 0)).select("key", "at", "base", F.transform(F.concat("base", "digest"), seed).alias("seeds"))


def _places(pieces: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, at, lead, words, i, form, pattern, ...) for each place in the pieces of one of the ``patterns``.

    Words go on only behind a word (``near``) that some pattern has; that look-up comes first, as most end there."""
    lower = F.regexp_replace(F.lower("text"), "[0-9]+", "0")
    left, right = _words(F.col("before")), _words(F.col("behind"))
    last = lambda k: F.when((F.col("before") != "") & (F.size(left) >= k), _plain(F.get(left, F.size(left) - k))).otherwise("")
    ahead = F.when(F.col("behind") != "", F.coalesce(_plain(F.get(right, F.lit(0))), F.lit(""))).otherwise("")
    row = F.concat(F.array(last(2), last(1)), F.regexp_extract_all(lower, F.lit(r"\S+"), 0), F.array(ahead))
    around = pieces.select("key", "at", F.length(F.regexp_extract("text", r"^\s*", 0)).alias("lead"), _words(F.col("text")).alias("words"), row.alias("row"))
    from_ = lambda k: F.slice("row", k, F.greatest(F.size("row") - 3, F.lit(0)))
    zipped = F.arrays_zip(from_(1).alias("far"), from_(2).alias("near"), from_(4).alias("behind"))
    each = around.select("key", "at", "lead", "words", F.posexplode(zipped).alias("i", "x"))
    each = each.withColumn("near", F.when(F.col("x.near") != "", F.xxhash64(F.lit(1), F.col("x.near"))))
    each = each.join(checked_broadcast(patterns.select("near").distinct()), "near", "left_semi")
    keys = _keys(F.col("x.far"), F.col("x.near"), F.col("x.behind"))
    each = each.select("key", "at", "lead", "words", "i", F.posexplode(keys).alias("form", "pattern")).where("pattern is not null")
    return each.join(checked_broadcast(patterns.drop("near")), "pattern")


def _scored(links: DataFrame, sure: DataFrame, rounds: int) -> DataFrame:
    """(pattern, trust) after ``rounds`` over the graph ``links`` (pattern, form, value); the values ``sure`` have 1.

    A pattern gives its instances credit with other patterns of its form only: not with itself, and not with those of
    other forms, which stand in the same places and are no evidence of their own."""
    links = durable(links.join(sure.withColumn("sure", F.lit(1.0)), "value", "left"), "graph")
    scored = durable(links.groupBy("pattern").agg(F.avg(F.coalesce("sure", F.lit(0.0))).alias("trust")), "scored")
    for _ in range(rounds - 1):
        credit = links.join(scored, "pattern")
        best = credit.groupBy("form", "value").agg(F.max(F.struct("trust", "pattern")).alias("best"))
        credit = credit.join(best, ["form", "value"])
        second = credit.where("pattern <> best.pattern").groupBy("form", "value").agg(F.max("trust").alias("second"))
        score = F.coalesce("sure", F.when(F.expr("pattern = best.pattern"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("best.trust")))
        scored = durable(credit.join(second, ["form", "value"], "left").groupBy("pattern").agg(F.avg(score).alias("trust")), "scored")
    discard(links)
    return scored


def bootstrap(pieces: DataFrame, found: DataFrame, support: int = SUPPORT, share: float = SHARE, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """(key, at, extra): spans, within their piece, that trusted patterns mark beside the base spans ``found``."""
    seeds = durable(found.select(F.inline("seeds")).select(F.posexplode("keys").alias("form", "pattern"), F.get("keys", F.lit(0)).alias("near"), "value", "kind").where("pattern is not null"), "seeds")
    # Each kind of a pattern's distinct seeds; the most frequent one names what the pattern finds, the first of equals.
    kinds = seeds.groupBy("pattern", "near", "kind", "value").agg(F.count("*").alias("n")).groupBy("pattern", "near", "kind").agg(F.count("*").alias("d"), F.sum("n").alias("n"))
    patterns = kinds.groupBy("pattern").agg(F.min("near").alias("near"), F.sum("d").alias("d"), F.sum("n").alias("n"), F.max(F.struct("d", -F.col("kind"))).alias("top"))
    patterns = durable(patterns.where(F.col("d") >= support).selectExpr("pattern", "near", "n", "-top.col2 kind"), "patterns")
    # Words in the places of each pattern, counted where they stand: patterns that mostly name other things end here.
    seen = durable(_places(pieces, patterns.select("pattern", "near")).groupBy("pattern").agg(F.count("*").alias("all")), "seen")
    likely = durable(patterns.join(seen, "pattern").where(F.col("n") >= share * F.col("all")).select("pattern", "near", "kind"), "likely")
    hits = _places(pieces, likely).select("key", "at", "form", "pattern", "kind", F.get("words", F.col("i")).alias("word"), F.expr("lead + aggregate(transform(slice(words, 1, i), w -> length(w)), 0, (a, b) -> a + b)").alias("start"))
    hits = hits.dropDuplicates(["key", "at", "start", "pattern"])
    word = F.rtrim("word", F.lit(_BLANKS))
    core = F.regexp_replace(word, _OPEN, "")
    value = F.regexp_replace(core, _CLOSE, "")
    start = F.col("start") + F.length(word) - F.length(core)
    hits = hits.select("key", "at", "form", "pattern", "kind", value.alias("value"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end")).where("value <> ''")
    base = found.where(F.size("base") > 0).select("key", "at", "base").dropDuplicates(["key", "at"])
    hits = hits.join(base, ["key", "at"], "left").withColumn("known", F.expr("coalesce(exists(base, b -> start < b.end and b.start < end), false)")).drop("base")
    hits = durable(hits, "hits")
    links = hits.select("pattern", "form", "value").union(seeds.join(checked_broadcast(likely.select("pattern")), "pattern", "left_semi").select("pattern", "form", "value")).distinct()
    # A word that is part of a base entity, as with a mark behind it, is as sure as the entity.
    sure = durable(seeds.select("value").union(hits.where("known").select("value")).distinct(), "sure")
    scored = _scored(links, sure, rounds)
    good = scored.where(F.col("trust") >= trust)
    best = hits.where("not known").join(good, "pattern").groupBy("key", "at", "start", "end").agg(F.max(F.struct("trust", -F.col("kind"))).alias("top"))
    extra = best.groupBy("key", "at").agg(F.collect_list(F.struct("start", F.expr("-top.col2").cast("int").alias("kind"), "end")).cast(SPAN).alias("extra"))
    extra = durable(extra, "extra")
    for t in (seeds, patterns, seen, likely, hits, sure, scored):
        discard(t)
    return extra


def _key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(key, pieces): for each text with spans its pieces in order, each (at, base, found), the spans within the piece.

    The key is the MD5 of the text. The base patterns go over each text once."""
    pieces = _pieces(docs.where("text <> ''").select(_key().alias("key"), "text"))
    found = durable(_found(pieces), "found")
    extra = bootstrap(pieces, found)
    base = found.where(F.size("base") > 0).select("key", "at", "base").dropDuplicates(["key", "at"])
    both = base.join(extra, ["key", "at"], "full").select("key", "at", *(F.coalesce(c, F.array().cast(SPAN)).alias(c) for c in ("base", "extra")))
    piece = F.struct("at", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "extra")).alias("found"))
    out = durable(both.groupBy("key").agg(F.array_sort(F.collect_list(piece)).alias("pieces")), "spans")
    discard(found)
    discard(extra)
    return out


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the pieces of each text in a column of a new name."""
    taken = {c.lower() for c in docs.columns}
    name = "_pii"
    while name in taken or name + "_key" in taken:
        name += "_"
    spans = personal_spans(docs).select(F.col("key").alias(name + "_key"), F.col("pieces").alias(name))
    spans = checked_broadcast(spans, weight=F.aggregate(name, F.lit(4), lambda a, p: a + 4 + F.size(p["found"])))
    return docs.withColumn(name + "_key", _key()).join(spans, name + "_key", "left").drop(name + "_key"), name


def _spans(pieces: str, which: str) -> Column:
    moved = F.transform(pieces, lambda p: F.transform(p[which], lambda s: F.struct((s["start"] + p["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + p["at"]).alias("end"))))
    return F.coalesce(F.flatten(moved), F.array().cast(SPAN))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the columns base and found: spans (start, kind, end) in code points.

    ``found`` has the base spans and those that the bootstrap adds beside them. Null and empty texts have none; equal
    texts have equal spans, rows are kept whatever repeats; an empty table gives no rows. Columns of the input called
    base or found give way."""
    rows, name = _marked(docs.drop("base", "found"))
    return rows.select("*", _spans(name, "base").alias("base"), _spans(name, "found").alias("found")).drop(name)


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of the text replaced by its kind in brackets; overlapping spans become one.

    All columns keep their values, but for a column n_chars, which follows the text."""
    rows, name = _marked(docs)
    names = F.array(*(F.lit(k) for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def masked(p, i):
        # A piece of the text goes from its own start to the next one's; the first takes what stands before it.
        begin, end = F.when(i > 0, p["at"]).otherwise(0), F.coalesce(F.get(F.col(name), i + 1)["at"], F.length("text"))
        text = F.substr(F.col("text"), begin + 1, end - begin)

        def step(acc, s):
            a, b = s["start"] + p["at"] - begin, s["end"] + p["at"] - begin
            fresh = F.concat(acc["out"], F.substr(text, acc["at"] + 1, a - acc["at"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
            return F.struct(F.greatest(acc["at"], b).alias("at"), F.when(a >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

        return F.aggregate(p["found"], zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))

    text = F.when(F.size(name) > 0, F.array_join(F.transform(name, masked), "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)
