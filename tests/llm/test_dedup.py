"""SimHash, embedding near-duplicates, nearest neighbours and components against brute force."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import ann, graph, rabitq, simhash

DOC = "doc_id long, text string"
VEC = "vec_id long, embedding array<float>, label int"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB\u00c9 \t\n\u00a0x.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base[:8]:
        for k in range(6):
            c = list(b)
            for _ in range(k):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return [*out, None, "", "   ", "one", "ONE", "one two", "x " * 20000, out[0], out[0]]


def test_near_duplicates_against_all_pairs(spark):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), DOC)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    f = [plain_fingerprint(x) for x in t]
    want = roots(len(t), [(i, j) for i in range(len(t)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    assert [got[i]["fp"] & (2**64 - 1) for i in range(len(t))] == f
    assert [got[i]["component_id"] for i in range(len(t))] == want


@pytest.mark.parametrize(("distance", "segments"), [(2, 2), (3, 2), (1, 1), (3, 4)])
def test_links_lose_no_pair(spark, distance, segments):
    rng = random.Random(distance)
    f = {rng.getrandbits(64) for _ in range(30)}
    for x in list(f):
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, distance + 1)):
                y ^= 1 << b
            f.add(y)
    f = sorted(f)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(f)], "fp long, rep long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(df, distance, segments).collect()}
    assert got == {(i, j) for j in range(len(f)) for i in range(j) if (f[i] ^ f[j]).bit_count() <= distance}


def test_near_duplicates_of_odd_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).collect() == []
    rows = [(5, "a b c d", "x", 1), (5, "a b c d", "x", 1), (None, "a b c d", None, None), (9, "other words here now", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (9, 9)], key=str)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (500, 500)]
    random.Random(1).shuffle(edges)
    got = {r["v"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50)) and got[500] == 500
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(n=300, dim=32, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(0, 120, 3):
        c = rng.uniform(0.93, 0.999)
        u = x[k] / np.linalg.norm(x[k])
        v = rng.standard_normal(dim)
        v -= (v @ u) * u
        x[k + 1] = c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)
    x[200:230] = x[200] + 0.05 * rng.standard_normal((30, dim))
    x[240:250] = x[240]
    return x.astype(np.float32)


def odd_rows(dim=32):
    return [(1000, None, 0), (1001, [0.0] * dim, 0), (1002, [float("nan")] * dim, 0), (1003, [None, *[1.0] * (dim - 1)], 0), (1004, [float("inf"), *[1.0] * (dim - 1)], 0), (1005, [], 0)]


@pytest.mark.parametrize("failure", [0.0, 1e-6, 1e-3])
def test_embedding_near_duplicates_against_all_pairs(spark, failure):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + odd_rows(), VEC)
    got = {r["vec_id"]: r for r in rabitq.near_duplicates(df, failure=failure).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = roots(len(x), [(i, j) for i in range(len(x)) for j in range(i) if near[i, j]])
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == want
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(1000, 1006))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_large_buckets_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 40)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    got = {r["vec_id"]: r["n_links"] for r in rabitq.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert [got[i] for i in range(len(x))] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def test_estimates_and_their_bounds():
    x = rabitq.units(list(vectors(seed=5)))
    codes, factor = rabitq.encode(x)
    assert codes.shape == (300, 4)
    q, scale, err = rabitq.quantised(x)
    rotated = x @ rabitq.rotation(32, 0).T
    assert np.allclose(np.linalg.norm(rotated - q * scale[:, None], axis=1), err) and err.max() < 0.02
    estimate = rotated @ rabitq.signs(codes, 32).T / factor
    near = x @ x.T >= 0.95
    assert (estimate >= rabitq.bound(factor, 32, 0.95, 0) - 1e-6)[near].all()
    assert abs((estimate - x @ x.T)[~near].mean()) < 0.02  # unbiased
    loose, tight = rabitq.bound(factor, 32, 0.95, 1e-6), rabitq.bound(factor, 32, 0.95, 1e-2)
    assert (rabitq.bound(factor, 32, 0.95, 0) <= loose).all() and (loose < tight).all() and (tight < 0.95).all()
    assert (rabitq.bound(factor, 512, 0.95) > rabitq.bound(factor, 64, 0.95)).all()


def test_bound_fails_no_more_often_than_stated():
    rng = np.random.default_rng(8)
    dim, failure, n = 64, 0.05, 4000
    x = rabitq.units(list(rng.standard_normal((n, dim))))
    other = rng.standard_normal((n, dim))
    other -= (other * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    codes, factor = rabitq.encode(x)
    estimate = ((y @ rabitq.rotation(dim, 0).T) * rabitq.signs(codes, dim)).sum(1) / factor
    missed = (estimate < rabitq.bound(factor, dim, 0.95, failure)).mean()
    assert missed <= failure and (estimate < 0.95).mean() > 0.3  # the bound is needed, and holds


def test_few_pairs_are_computed_exactly(spark):
    x = np.random.default_rng(3).standard_normal((1200, 64)).astype(np.float32)
    x[600] = x[0] + 0.01
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    rows = rabitq.near_duplicates(df).collect()
    assert 1 <= sum(r["n_exact"] for r in rows) < 1200 * 1199 / 2 / 100
    assert {r["vec_id"] for r in rows if r["n_links"]} == {0, 600}


def test_embedding_near_duplicates_of_odd_tables(spark):
    assert rabitq.near_duplicates(spark.createDataFrame([], VEC)).collect() == []
    rows = [(1, [1.0, 2.0], 0, 7), (1, [1.0, 2.0], 0, 7), (2, [2.0, 4.0], 0, 7), (3, [1.0, 2.0, 3.0], 0, 7)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rabitq.near_duplicates(spark.createDataFrame(rows, VEC + ", links int")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_nearest_neighbours_reach_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 400)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x[700:720] = x[700]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + odd_rows(), VEC)
    rows = ann.search(ann.index(ann_points(df), 400), ann_queries(df)).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(1500), key=lambda j: (-s[j], j))[:5]
        hits += len({v for v, _ in found[q]} & set(want))
        assert all(abs(score - s[v]) < 1e-9 for v, score in found[q]) and len(found[q]) == 5
    assert hits / (5 * 30) >= 0.9
    assert [v for v, _ in found[700]] == [701, 702, 703, 704, 705]


def test_vectors_that_share_an_id_have_their_own_links(spark):
    rng = np.random.default_rng(8)
    a, b, c = rng.standard_normal((3, 32))
    near = lambda x: (x + 0.02 * rng.standard_normal(32)).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a)), (3, near(b)), (3, near(b)), (7, c.tolist()), (7, near(c)), (None, near(c)), (None, rng.standard_normal(32).tolist())]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rabitq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([("1", 1, "1"), ("1", 2, "1"), ("2", 1, "1"), ("3", 2, "1"), ("3", 2, "1"), ("7", 2, "7"), ("7", 2, "7"), ("None", 2, "7"), ("None", 0, "None")])


def ann_points(df):
    from pyspark.sql import functions as F

    rows = df.where(rabitq.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, 6).alias("ids"))


def ann_queries(df):
    from pyspark.sql import functions as F

    return df.where(rabitq.usable(F.col("embedding")) & (F.col("vec_id") % 50 == 0)).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))


def test_nearest_of_scaled_copies_takes_the_smallest_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1300, 16))
    x[100:800] = x[100] * rng.uniform(0.1, 9, (700, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(found) == 26 and all(len(v) == 5 for v in found.values())
    for q in range(100, 800, 50):
        assert set(found[q]) <= set(range(100, 107)) and len([v for v in found[q] if v <= 105]) >= 4


def test_nearest_of_one_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.2]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (2, [1.0, 0.3])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]


def test_nearest_of_odd_tables(spark):
    assert ann.nearest(spark.createDataFrame([], VEC)).collect() == []
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (2, [0.0, 1.0], 0), (3, None, 0), (None, [1.0, 0.0], 0), (50, [0.0, 0.0], 0)]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(spark.createDataFrame(rows, VEC)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]


def test_pruned_graph_reaches_all_points():
    x = rabitq.units(list(np.random.default_rng(1).standard_normal((500, 16)))).astype(np.float32)
    g, entries = ann.build(x, degree=16, beam=32)
    entry = int(entries[0])
    assert g.shape == (500, 24) and all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(g))
    seen, todo = {entry}, [entry]
    while todo:
        for j in g[todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) == 500
