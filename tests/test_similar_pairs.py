"""Perceptual pairs against all pairs, over more rows than any window."""

import random

import pytest

from lumora.operators import similarity


def near(rng, x, bits, flips):
    for b in rng.sample(range(bits), flips):
        x ^= 1 << b
    return x


@pytest.mark.parametrize(("bits", "distance"), [(64, 7), (256, 20), (64, 0), (48, 5)])
def test_similar_pairs_are_all_pairs(spark, bits, distance):
    rng = random.Random(5)
    base = [rng.getrandbits(bits) for _ in range(1200)]
    twins = [near(rng, x, bits, rng.randint(0, 2 * distance)) for x in base]
    h = dict(enumerate(base + twins))
    digits = bits // 4
    rows = spark.createDataFrame([(i, f"{x:0{digits}x}") for i, x in h.items()] + [(9000, None), (9001, "no hex"), (9002, ""), (9003, "0")], "id long, phash string")
    got = sorted(tuple(r) for r in similarity.similar_pairs(rows, rows, distance, digits).collect())
    want = sorted((i, j, d) for i, x in h.items() for j, y in h.items() if i != j and (d := (x ^ y).bit_count()) <= distance)
    assert got == want and (distance == 0 or len(want) > 500)


def test_segments_cover_every_pattern_of_differences():
    rng = random.Random(3)
    for words, distance in ((1, 3), (4, 20), (2, 1), (4, 2)):
        cuts = similarity.segments_for(words, distance)
        assert sum(s.radius + 1 for s in cuts) == distance + 1 and all(s.radius <= 1 for s in cuts)
        for _ in range(200):
            x = near(rng, 0, 64 * words, distance)
            parts = [(x >> (64 * s.word + s.offset)) & ((1 << s.width) - 1) for s in cuts]
            assert any(p.bit_count() <= s.radius for p, s in zip(parts, cuts))
    with pytest.raises(ValueError):
        similarity.segments_for(1, -1)


def test_a_group_of_equal_hashes_is_one_class(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, None, "f" * 64, "review", at + datetime.timedelta(minutes=i)) for i in range(1, 300)] + [(900, None, "f" * 63 + "e", "skipped", at)]
    df = spark.createDataFrame(rows, "id long, md5 string, phash string, status string, created_at timestamp_ntz")
    got = {r["id"]: r["original"] for r in similarity.originals(df).collect()}
    assert got == {1: None, **{i: 1 for i in range(2, 300)}, 900: None}


def test_look_ups_are_not_broadcast_and_a_shared_end_is_no_hot_key(spark):
    from collections import Counter

    rng = random.Random(9)
    rows = spark.createDataFrame([(i, f"{rng.getrandbits(184):046x}" + "0" * 18) for i in range(2000)], "id long, phash string")
    pairs = similarity.similar_pairs(rows, rows, 20, 64)
    pairs.collect()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    cuts = similarity.segments_for(4, 20)
    words = [r["words"] for r in similarity._hashes(rows, "id", 64, len(cuts)).collect()]
    for s in cuts:
        keys = Counter(((w[s.word] & ((1 << 64) - 1)) >> s.offset) & ((1 << s.width) - 1) for w in words)
        assert max(keys.values()) < 20
