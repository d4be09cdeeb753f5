"""Near-duplicates of the pipeline's stage against exact Jaccard over all pairs."""

import random

import numpy as np

from lumora.llm import simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_ids(rows, least=0.8):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def edited():
    """Originals with copies changed in some words, chains of copies, texts that share a passage, odd texts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for k in range(25):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        texts.append(base)
        for _ in range(4):
            copy = list(base if k % 3 else texts[-1])
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.choice([5, 10, 20, 30, 40]) // 1000)):
                copy[at] = word()
            texts.append(copy)
    passage = [word() for _ in range(100)]
    texts += [[word() for _ in range(60)] + passage for _ in range(20)]
    base = [word() for _ in range(200)]
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(200), 2):
            copy[at] = word()
        texts.append(copy)
    rows = [" ".join(t) for t in texts] + [None, "", " ", "a b", "A  b", "a b c d e f", "a b c d e g"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_keeps_one_of_each_group_by_exact_jaccard(spark):
    import corpus_pipeline as p

    rows = edited()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    assert sorted(r["doc_id"] for r in p.near_dedup(spark, docs, "").collect()) == kept_ids(rows)


def test_stage_on_documents_by_exact_jaccard(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(r["doc_id"] for r in p.near_dedup(spark, docs, sf).collect()) == kept_ids(rows)


def test_odd_tables(spark):
    assert simhash.near_copies(spark.createDataFrame([], DOC)).collect() == []
    rows = [(5, "a b", "", "", 1), (5, "a b", "", "", 1), (None, "a b", "", "", 1), (9, "c", "", "", 1), (9, "d", "", "", 1), (12, "d", "", "", 1), (None, "z", "", "", 1)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_copies(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (9, 9), (9, 9), (12, 9), (None, None)], key=str)


def test_check_bits_lose_no_pair(spark, monkeypatch):
    """Sets of 4 and 5 shingles that share 4 and whose check bits are farther apart than ``miss`` stands for; then all so."""
    words = "w1926 w1866 w2631 w1351 w2566 w309 w1137 w2245 w722".split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:8])), (3, "some other text of its own with nine words here")]
    sets = [simhash.shingles(t) for _, t in rows]
    apart = int((simhash.long_fingerprint(sets[0], simhash.CHECK_BITS) != simhash.long_fingerprint(sets[1], simhash.CHECK_BITS)).sum())
    assert len(np.intersect1d(sets[0], sets[1])) == 4 and apart > simhash.check_distance(0.8, 1e-9)
    got = simhash.near_copies(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (3, 3)]
    monkeypatch.setattr(simhash, "check_distance", lambda *_: -1)
    rows = edited()
    got = simhash.near_copies(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] == r["component_id"]) == kept_ids(rows)


def test_stage_compares_documents_without_an_id_and_keeps_texts_that_share_one(spark):
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(100)]
    base, edit, other = " ".join(words), " ".join([*words[:99], "x"]), " ".join(words[::-1])
    near = " ".join([*words[:50], "y", *words[51:]])
    rows = [(None, base), (None, base), (7, edit), (8, near), (None, other), (None, f"{other} z"), (9, "a b c d e f"), (9, "g h i j k l"), (9, "g h i j k l"), (10, "g h i j k l"), (None, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = [(r["doc_id"], r["text"]) for r in p.near_dedup(spark, docs, "").collect()]
    assert len(got) == 5 and sorted(t for i, t in got if i is not None) == sorted([edit, "a b c d e f", "g h i j k l"]) and (9, "g h i j k l") in got
    assert sorted((t or "").strip()[:4] for i, t in got if i is None) == ["", "w99 "]


def test_hot_keys_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    rows = edited()
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC), miss=1e-6).collect()}
    assert sorted(i for i, c in got.items() if i == c) == kept_ids(rows)


def test_a_crowd_of_edited_copies_makes_few_pairs(spark, monkeypatch):
    """Copies too far apart to link with one another, but not with their original, and some that link with nothing."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 61):
        copy = list(base)
        for at in rng.sample(range(80), 6 if i % 4 else 14):  # five shingles each
            copy[5 * at + 2] = f"e{i}.{at}"
        rows.append((i, " ".join(copy)))
    seen, real = [], simhash.checkpointed

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "checkpointed", counted)
    got = simhash.near_copies(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] == r["component_id"]) == kept_ids(rows) == [0, *range(4, 61, 4)]
    assert sum(seen) < 5 * len(rows)


def test_pairs_meet_as_often_as_stated():
    rng = np.random.default_rng(2)
    for least in (0.8, 0.9):
        k, m = simhash.segments_for(1 << 18, least, 0.02)
        met = 0
        for _ in range(400):
            n = 180
            shared = rng.integers(0, 1 << 63, int(2 * n * least / (1 + least)) + 1, np.uint64)
            own = [np.concatenate([shared, rng.integers(0, 1 << 63, n - len(shared), np.uint64)]) for _ in range(2)]
            a, b = (simhash.long_fingerprint(s, m * k).reshape(m, k) for s in own)
            met += ((a != b).sum(1) <= 1).any()
        assert met / 400 >= 0.96


def test_long_fingerprint_is_the_majority():
    h = simhash.shingles("one two three four five six seven eight nine ten")
    bits = simhash.long_fingerprint(h, 128)
    assert bits.shape == (128,) and 30 < bits.sum() < 98
    assert (simhash.long_fingerprint(np.repeat(h, 3000), 128) == bits).all() and not simhash.long_fingerprint(h[:0], 64).any()
