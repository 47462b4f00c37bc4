"""URL filter by association rules: FP-growth mines combinations of URL tokens that go with a label.

Urls become transactions of all their tokens. Sets of tokens that are frequent with a label give rules "tokens ->
label", kept by support and confidence unless a shorter rule says the same at least as surely. Where labels are picked by
rules of their own, a set may have one label only because the others of its urls have none; so urls without a label are
mined along, and a set gives a rule only if labels cover a fair share of all the urls that have it. The sets are grown in parallel, one
group a frequent token: its conditional base has the more frequent tokens of the transactions that it is in. A url is judged by an inverted
index: each rule is listed under its rarest token, and is tried only on urls that have that token.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): fits the host and its subdomains where the path begins with the rule's; the longest wins.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules have at most MAX_TOKENS tokens; transactions are mined whole. A rule holds in a share of MIN_SUPPORT at least, so
#: there are at most C(n, <=4) / 0.01 rules if the urls have n frequent tokens: under 110,000 for 13 of them.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.8, 4
#: Share of the urls with a rule's tokens that must have a label, and the name of those that have none.
MIN_COVER, UNLABELLED = 0.5, ""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as a string, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host suffixes and words, path segments (numbers as one token), query keys."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.split(host, r"[.-]"), lambda x: F.concat(F.lit("word:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("key:"), x))
    found = F.concat(suffixes, segments, words, F.coalesce(keys, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("host:", "word:", "path:", "key:")))


def _most(n: Counter) -> int:
    """Rows of the most frequent label."""
    return max((m for label, m in n.items() if label != UNLABELLED), default=0)


def _grow(base: list[tuple[tuple, Counter]], suffix: tuple, least: int) -> Iterator[tuple[tuple, Counter]]:
    """(tokens, rows by label) of the sets that end in ``suffix`` and are frequent with a label.

    ``base`` has the tokens before the suffix, most frequent first. A set of one label only is not grown on: longer
    rules say the same, and none more surely."""
    found: dict[int, Counter] = defaultdict(Counter)
    for row, n in base:
        for t in row:
            found[t].update(n)
    for t, n in found.items():
        if _most(n) >= least:
            yield (*suffix, t), n
            if len(n) > 1 and len(suffix) + 1 < MAX_TOKENS:
                shorter: dict[tuple, Counter] = defaultdict(Counter)
                for row, m in base:
                    if t in row:
                        shorter[row[: row.index(t)]].update(m)
                yield from _grow(list(shorter.items()), (*suffix, t), least)


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_cover: float = MIN_COVER) -> list[tuple[frozenset, str, float, float]]:
    """Rules (tokens, label, confidence, support) from ``urls`` (tokens, label); none without labels.

    Confidence and support are shares of the urls that have a label; the others only count against a rule's cover."""
    rows = urls.select("tokens", F.coalesce("label", F.lit(UNLABELLED)).alias("label"))
    real = F.col("label") != UNLABELLED
    total = rows.where(real).count()
    if not total:
        return []
    least = max(1, ceil(min_support * total))
    counts = rows.where(real).select("label", F.explode("tokens").alias("token")).groupBy("token", "label").count().groupBy("token").agg(F.max("count").alias("most"), F.sum("count").alias("n"))
    names = [r["token"] for r in counts.where(F.col("most") >= least).orderBy(F.desc("n"), "token").collect()]
    rank = {t: i for i, t in enumerate(names)}

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = Counter()
            for row, label in zip(batch["tokens"], batch["label"]):
                n[tuple(sorted(rank[t] for t in row if t in rank)), label] += 1
            out = [(row[i], row[:i], label, m) for (row, label), m in n.items() for i in range(len(row))]
            yield pd.DataFrame(out, columns=["item", "before", "label", "n"])

    def grown(group: pd.DataFrame) -> pd.DataFrame:
        item, base = int(group["item"].iloc[0]), defaultdict(Counter)
        for row, label, n in zip(group["before"], group["label"], group["n"]):
            base[tuple(int(t) for t in row)][label] += int(n)
        whole: Counter = Counter()
        for n in base.values():
            whole.update(n)
        out = []
        for tokens, n in [((item,), whole), *(_grow(list(base.items()), (item,), least) if len(whole) > 1 else ())]:
            every = sum(n.values())
            labelled = every - n[UNLABELLED]
            if labelled >= min_cover * every:
                out += [([names[t] for t in tokens], label, m / labelled, m / total) for label, m in n.items() if label != UNLABELLED and m >= least and m / labelled >= min_confidence]
        return pd.DataFrame(out, columns=["antecedent", "label", "confidence", "support"])

    based = rows.mapInPandas(ranked, "item int, before array<int>, label string, n long").groupBy("item", "before", "label").agg(F.sum("n").alias("n"))
    found = based.groupBy("item").applyInPandas(grown, "antecedent array<string>, label string, confidence double, support double")
    rules = [(frozenset(r["antecedent"]), r["label"], r["confidence"], r["support"]) for r in found.collect()]
    rules.sort(key=lambda r: (len(r[0]), -r[2], sorted(r[0])))
    kept: list[tuple[frozenset, str, float, float]] = []
    by_token = defaultdict(list)
    for r in rules:
        if not any(k[1] == r[1] and k[2] >= r[2] and k[0] < r[0] for t in r[0] for k in by_token[t]):
            kept.append(r)
            by_token[min(r[0])].append(r)
    return kept


def judge(rules: list[tuple[frozenset, str, float, float]], default: str):
    """A function of a tokens column: the label of the surest rule that fits, else ``default``."""
    use = defaultdict(int)
    for r in rules:
        for t in r[0]:
            use[t] += 1
    index = defaultdict(list)
    for r in sorted(rules, key=lambda r: (-r[2], -r[3], sorted(r[0]))):
        index[min(r[0], key=lambda t: (use[t], t))].append((-r[2], -r[3], tuple(sorted(r[0])), r[1]))
    index = dict(index)

    @F.pandas_udf("string")
    def label(column: pd.Series) -> pd.Series:
        out = []
        for row in column:
            have = set(row) if row is not None else set()
            fit = [r for t in have for r in index.get(t, ()) if have.issuperset(r[2])]
            out.append(min(fit)[3] if fit else default)
        return pd.Series(out, dtype=object)

    return label


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url, ...).

    A url that a listed rule decides has that rule and its verdict, and serves as a labelled example; the others have
    a null rule and the verdict of the mined rules, ``default`` if none fits. Null urls, urls without "://" and
    repeated rows are judged like any other; an empty table gives no rows."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("label"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = judge(mine(base.select("tokens", "label")), default)
    return base.select("page_id", "host", "path", "rule", F.coalesce("label", mined(F.coalesce("tokens", F.array().cast("array<string>")))).alias("verdict"))
