"""URL filter: allow and block rules, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import read

#: Weight from which a url is blocked: that of one strict term, or of several different soft ones.
BLOCKED = 2
#: Terms by weight.
STRICT, SOFT = 2, 1
VOCABULARY = {
    STRICT: "porn porno pornographic xxx hentai nsfw escort escorts camgirl camgirls fetish adult "
    "casino casinos gambling sportsbook blackjack roulette jackpot "
    "viagra cialis levitra tramadol steroids "
    "phishing malware ransomware spyware botnet keylogger keygen warez spam spammer".split(),
    SOFT: "sex sexy nude nudes erotic dating hookup singles cam cams hot "
    "poker slots slot bet bets betting lottery bingo win winner wins odds "
    "pills pharma pharmacy cheap replica replicas discount discounts coupon coupons deal deals bargain "
    "free bonus click clicks track ads adserver popunder farm affiliate referral giveaway prize "
    "loan loans payday credit forex crypto airdrop earn income rich "
    "crack cracked torrent torrents serial hack hacks cheats proxy unblocked".split(),
}
#: Terms of a vocabulary at most; some 100 bytes each in the automaton of a task.
MOST_TERMS = 1_000_000
#: (action, host, path): the rule fits the host and its subdomains where the path starts with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and urls without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does. Length counts host and path together."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def terms_of(vocabulary: DataFrame) -> tuple[tuple[str, int], ...]:
    """The terms of a table (term, weight), in lower case, for ``judged``; a term's highest weight counts. Null and empty
    terms are none. More than MOST_TERMS raise."""
    rows = vocabulary.select(F.lower("term").alias("term"), F.col("weight").cast("int").alias("weight")).where("term <> '' AND weight > 0")
    found = rows.groupBy("term").agg(F.max("weight").alias("weight")).orderBy("term").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple((r["term"], r["weight"]) for r in found)


TERMS = tuple((t, w) for w, terms in VOCABULARY.items() for t in terms)


@lru_cache(4)
def automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t, w in sorted(terms, key=lambda x: x[1]):  # a term given twice has its highest weight
        a.add_word(t.lower(), (w, t.lower()))
    a.make_automaton()
    return a


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def weigh(url: str | None, a: ahocorasick.Automaton) -> tuple[int, int, int]:
    """(weight, strict, soft): the summed weights of the different terms in the lower-cased url that have no ASCII letter or
    digit beside them, and their numbers from BLOCKED on and below."""
    if not url or not len(a):
        return 0, 0, 0
    low = "".join(c.lower() if c.isascii() else c for c in url)
    found = {}
    for end, (weight, term) in a.iter(low):
        start = end - len(term) + 1
        if (start == 0 or not _word(low[start - 1])) and (end + 1 == len(low) or not _word(low[end + 1])):
            found[term] = weight
    strict = sum(w >= BLOCKED for w in found.values())
    return sum(found.values()), strict, len(found) - strict


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, terms: tuple[tuple[str, int], ...] = TERMS) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, weight), one row per row of ``pages`` (page_id, url).

    The longest rule that fits decides; else a url is blocked whose different terms (``terms``: term and weight, from
    ``terms_of`` for a table) weigh BLOCKED together. A null or empty url has empty host and path and is allowed. One
    pass without a shuffle; the vocabulary is built into the automaton once per worker.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(tuple(terms))
        for urls in batches:
            yield pd.DataFrame([weigh(u, a) for u in urls], columns=["weight", "n_strict", "n_soft"])

    counted = F.pandas_udf(run, "weight int, n_strict int, n_soft int")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), counted("url").alias("terms"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("terms.weight") >= BLOCKED, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"), "terms.n_strict", "terms.n_soft", "terms.weight")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"))


def oracle() -> str:
    """DuckDB SQL for ``op3_url_filter``: the terms by regular expressions."""

    def hit(term: str) -> str:
        return f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INTEGER)"

    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, act) for act, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    action = " ".join(f"WHEN {f} THEN '{a}'" for f, _, a in fits)
    return f"""
    WITH u AS (
      SELECT page_id, translate(coalesce(url, ''), '{up}', '{low}') AS low,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{up}', '{low}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    t AS (SELECT *, {" + ".join(map(hit, VOCABULARY[STRICT]))} AS n_strict, {" + ".join(map(hit, VOCABULARY[SOFT]))} AS n_soft FROM u)
    SELECT page_id, host, path, CASE {rule} END AS rule,
      CASE {action} WHEN {STRICT} * n_strict + {SOFT} * n_soft >= {BLOCKED} THEN 'block' ELSE 'allow' END AS verdict,
      CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft, CAST({STRICT} * n_strict + {SOFT} * n_soft AS INTEGER) AS weight
    FROM t"""
