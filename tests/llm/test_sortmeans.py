"""Sort-means against all distances, and the query against its SQL and a plain version."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import sortmeans
from tests.oracle import connect, same_rows


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 9), st.integers(1, 4), st.integers(1, 3))
def test_assignment_with_ties(seed, k, dim, spread):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-spread, spread + 1, (60, dim)), rng.integers(-spread, spread + 1, (k, dim))
    got, d = sortmeans.assign(x, c, rng.integers(0, k, 60))
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (got == every.argmin(1)).all() and (d == every.min(1)).all()


def plain(rows, k=16, rounds=3):
    """The contract for rows (vec_id, components), by all distances in Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    tag = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=tag)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if own := [v for (_, v), m in zip(kept, of) if m == n]:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    by = [sum(d for d, n in last if n == m) for m in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, by[n], sum(by), sha[n]) for (i, _), (d, n) in zip(kept, last)]


def order(r):
    return tuple((x is None, x) for x in r)


def test_query_with_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(int(i), [float(x) for x in rng.normal(size=64)]) for i in range(150)]
    odd = [(3, None), (4, []), (5, [1.0] * 63), (6, [math.nan] * 64), (7, [*[1.0] * 63, math.inf]), (8, [*[1.0] * 63, None]), (9, [0.0] * 64), (10, [0.0] * 64), (1, good[5][1]), (2, good[2][1]), (None, good[7][1]), (None, None)]
    rows = good + good[:5] + odd
    spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sortmeans.op11_sort_means(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain(rows), key=order)


def test_few_equal_and_no_vectors(spark, tmp_path):
    for n, rows in enumerate(([], [(1, [0.5] * 64)] * 20, [(None, [1.0] * 64), (2, [-1.0] * 64)], [(5, [1e300] * 64), (6, [-1e300] * 64)])):
        at = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
        got = [tuple(r) for r in sortmeans.op11_sort_means(spark, at).collect()]
        held = [(i, [max(-sortmeans.LARGEST / 64, min(sortmeans.LARGEST / 64, x)) for x in v]) for i, v in rows]
        assert sorted(got, key=order) == sorted(plain(held), key=order)


def test_query_against_its_sql(spark, sf):
    same_rows(connect(sf), sortmeans.oracle(), sortmeans.op11_sort_means(spark, sf))
