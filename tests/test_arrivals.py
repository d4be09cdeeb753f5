"""Which video is the original: arrivals one by one against the rounds, and the order and look-up helpers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumora.operators import order, similarity

SCHEMA = "id long, created_at timestamp, md5 string, phash string, status string"


def replay(rows, window, distance):
    """Each row judged in turn against the originals so far."""
    kept, out = [], {}
    for id_, at, md5, phash, status in sorted(rows, key=lambda r: (r[1], r[0])):
        same = [k for k in kept if md5 is not None and k[1] == md5]
        hashed = [k for k in kept if k[2] is not None][-window:]
        near = [k for k in hashed if phash is not None and (int(k[2], 16) ^ int(phash, 16)).bit_count() <= distance]
        found = (same[0][0], "md5") if same else (near[-1][0], "phash") if near else (None, None)
        out[id_] = found
        if found[0] is None and status != "skipped":
            kept.append((id_, md5, phash))
    return out


def check(spark, rows, window=500, distance=20, length=16):
    got = {r.id: (r.original, r.reason) for r in similarity.originals(spark.createDataFrame(rows, SCHEMA), window, distance, length).collect()}
    want = replay(rows, window, distance)
    assert got == want
    assert all(want[o][0] is None for o, _ in got.values() if o is not None)
    return got


def at(i):
    return datetime(2024, 1, 1) + timedelta(minutes=i)


def test_a_chain_and_an_old_pair(spark):
    h = lambda bits: f"{bits:016x}"
    chain = [(1, at(1), "a", h(0), "ready"), (2, at(2), "b", h((1 << 15) - 1), "ready"), (3, at(3), "c", h((1 << 30) - 1), "ready")]
    assert check(spark, chain) == {1: (None, None), 2: (1, "phash"), 3: (None, None)}
    rng = random.Random(1)
    far = [(100 + i, at(100 + i), f"m{i}", h(rng.getrandbits(64)), "ready") for i in range(600)]
    pair = [(1, at(0), "x", h(0), "ready"), (2, at(1), "y", h(3), "ready")]
    got = check(spark, pair + far, distance=3)
    assert got[2] == (1, "phash")


@pytest.mark.parametrize(("seed", "in_turn"), [(0, 0), (2, 40), (3, 1 << 17), (4, 1 << 17), (5, 1 << 17)])
def test_random_tables(spark, monkeypatch, seed, in_turn):
    """Few hashes and checksums, so that chains, large classes, and copies of both kinds meet; small windows; in rounds, in turn,
    and in rounds until few are left."""
    monkeypatch.setattr(similarity, "REPLAY", in_turn)
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    rows = []
    for i in range(90):
        h = rng.choice(centres)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(64)
        phash = rng.choice([f"{h:016x}"] * 8 + [None])
        rows.append((i, at(rng.randrange(60)), rng.choice([f"m{rng.randrange(40)}", f"u{i}", f"u{i}", None]), phash, rng.choice(["ready", "ready", "ready", "skipped"])))
    check(spark, rows, window=rng.choice([1, 2, 5, 500]), distance=3)


def test_no_rows_and_ill_formed_hashes(spark):
    assert similarity.originals(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, at(1), None, None, None), (2, at(2), None, "zz", "ready"), (3, at(3), None, "", "ready"), (4, at(4), None, "zz", None)]
    got = similarity.originals(spark.createDataFrame(rows, SCHEMA), length=16).collect()
    assert sorted((r.id, r.original) for r in got) == [(i, None) for i in range(1, 5)]


def test_places_sums_and_lookups_over_spans(spark, monkeypatch):
    monkeypatch.setattr(order, "SPAN", 4)
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randrange(5)) for i in rng.sample(range(60), 40)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    by_time = sorted(rows, key=lambda r: r[1])
    got = order.placed(df, ["t"], F.col("v") > 1).collect()
    assert sorted((r.t, r.pos, r.before) for r in got) == [(t, i, sum(x[2] > 1 for x in by_time[:i])) for i, (_, t, _) in enumerate(by_time)]
    got = order.running(df, "t", {"s": F.col("v")}).collect()
    assert sorted((r.t, r.s) for r in got) == [(t, sum(x[2] for x in by_time[:i])) for i, (_, t, _) in enumerate(by_time)]
    got = order.latest_before(df.select("k", "t"), df.where("v > 1").select("k", "t", "v"), ["k"], "t", {"last": F.col("t")}).collect()
    assert sorted((r.k, r.t, r.last) for r in got) == sorted((k, t, max((x[1] for x in rows if x[0] == k and x[2] > 1 and x[1] < t), default=None)) for k, t, _ in rows)
