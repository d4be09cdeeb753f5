"""Periodic runs against all stretches of small texts, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import periodic


def plain_runs(words):
    """All maximal stretches by their definition."""
    n, out = len(words), []

    def holds(a, b, q):
        return all(words[i] == words[i + q] for i in range(a, b - q))

    for a in range(n):
        for b in range(a + 6, n + 1):
            q = next(q for q in range(1, b - a + 1) if holds(a, b, q))
            if b - a >= 4 * q and not (a and words[a - 1] == words[a - 1 + q]) and not (b < n and words[b] == words[b - q]):
                out.append((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=28))
def test_runs_of_few_letters(words):
    assert periodic.runs_of(words) == plain_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=4), st.integers(1, 8)), max_size=4))
def test_runs_of_repeated_stretches(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert periodic.runs_of(words) == plain_runs(words)


def test_long_runs_in_parts(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 7)
    words = [b"x", *[b"p", b"q", b"p", b"r"] * 9, b"y", *[b"z"] * 11]
    assert periodic.runs_of(words) == plain_runs(words) == [(1, 36, 4), (38, 11, 1)]


def plain_row(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source = list(words)
        for i in range(a, n):
            words[i] = source[a + (i - a) % p]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *first, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_its_contract(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcé") for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += [None, "", " \t\n", "one", "a b c d e f " * 6, "x y x y\x0bx y\x0cx y\rx y x y", "A a A a A a A a", texts[0], texts[0]]
    rows = [(i, t, 1.5) for i, t in enumerate(texts)] + [(0, texts[0], 2.0), (None, "k k k k k k k", 0.0), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs double").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted((plain_row(k, t) for k, t, _ in rows), key=order)


def test_no_rows_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert periodic.periodic_runs(none).collect() == []
    long = spark.createDataFrame([(1, "w " * 200_000), (2, " ".join(map(str, range(60_000)))), (3, " ".join(str(i % 7_000) for i in range(60_000)))], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], len(r.collapsed.split())) for r in periodic.periodic_runs(long).collect()}
    assert got == {1: ([(0, 200_000, 1)], 1), 2: ([], 60_000), 3: ([(0, 60_000, 7_000)], 7_000)}


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_short_texts(n):
    assert periodic.runs_of([b"a"] * n) == ([(0, 6, 1)] if n == 6 else [])
