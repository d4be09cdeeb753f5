"""Merged Burrows-Wheeler transforms against all substrings, and the query against a plain version of its contract."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import bwtmerge


def covered(texts, length):
    """Bytes of each text that a string covers which starts at two places or more."""
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_anchors_are_in_their_windows_and_alike():
    rng = random.Random(2)
    part = bytes(rng.randrange(256) for _ in range(500))
    texts = [b"a" * 300, part, b"xyz" + part[100:400] + b"q", b"", b"short", b"ab" * 200]
    p, ends = bwtmerge.pieces_of(texts), np.cumsum([len(t) for t in texts])
    assert (p.first <= p.anchor).all() and (p.anchor + bwtmerge.GRAM <= p.first + bwtmerge.LENGTH + (p.last - p.first)).all()
    assert (p.last - p.first + 1).sum() == sum(max(0, len(t) - 199) for t in texts)
    at = {w: (int(a) - w, int(h)) for f, z, a, h in zip(p.first, p.last, p.anchor, p.hash) for w in range(int(f), int(z) + 1)}
    begin, other = int(ends[0]), int(ends[1]) + 3
    assert all(at[begin + 100 + i] == at[other + i] for i in range(101))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30))
def test_merging_shards_equals_one_transform(seed):
    rng = np.random.default_rng(seed)
    n, width, windows, length = int(rng.integers(2, 40)), 14, 5, 9
    x = rng.integers(0, 3, (n, width)).astype(np.uint8)
    edges = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
    shards = [bwtmerge.transform(np.ascontiguousarray(x[a:b].T), windows) for a, b in zip(edges, edges[1:])]
    weight, most = rng.integers(1, 3, n).astype(float), rng.integers(0, windows, n)
    got = bwtmerge.merged_repeats(shards, weight, np.zeros(n, int), most, length)
    for c in range(windows):
        offset = windows - 1 - c
        times = Counter()
        for i in range(n):
            if most[i] >= offset:
                times[x[i, c : c + length].tobytes()] += weight[i]
        assert got[:, offset].tolist() == [most[i] >= offset and times[x[i, c : c + length].tobytes()] >= 2 for i in range(n)]


def corpus(alphabet, seed):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    line, passage, whole = part(60), part(420), part(900)
    texts = [part(rng.randrange(1, 300)) + passage[rng.randrange(200) :] + part(rng.randrange(50)) for _ in range(15)]
    texts += [part(150) + line + part(150) for _ in range(10)] + [whole] * 8
    texts += [whole[:k] + "#" + whole[k + 1 :] for k in (0, 199, 200, 450, 899)]
    texts += [part(199) + passage[:199], "ab" * 250, "z" * 201, "z" * 200, "y" * 200, part(250) * 2, None, "", "  "]
    return texts


@pytest.mark.parametrize(("alphabet", "hot"), [("abcdefgh \n", None), ("aé漢😀", None), ("abcdefgh \n", 3)])
def test_query_against_its_contract(spark, tmp_path, monkeypatch, alphabet, hot):
    if hot:
        monkeypatch.setattr(bwtmerge, "HOT", hot)
    texts = corpus(alphabet, 5)
    rows = [(i if i % 7 else None, t, "k") for i, t in enumerate(texts)] + [(1, texts[1], "k"), (1, texts[2], "k")]
    spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = bwtmerge.op13_merged_bwt(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    data = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (i, _, _), t, gone in zip(rows, data, covered(data, 200)):
        kept = bytes(x for x, g in zip(t, gone) if not g)
        want.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_no_rows_and_no_repeats(spark):
    schema = "doc_id long, text string"
    assert bwtmerge.without_repeats(spark.createDataFrame([], schema)).collect() == []
    got = bwtmerge.without_repeats(spark.createDataFrame([(1, "a"), (2, None), (3, "".join(map(str, range(900))))], schema)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.removed, len(r.kept)) for r in got) == [(1, 1, [], 1), (2, 0, [], 0), (3, 2590, [], 2590)]
