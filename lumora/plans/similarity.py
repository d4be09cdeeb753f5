"""Queries over fingerprints and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import hashing as h
from lumora.operators import similarity as op
from lumora.operators.library import alive
from lumora.plans.base import query
from lumora.sources import catalog as cat


@query("e01_md5", "SELECT doc_id AS id, md5(text) AS md5 FROM documents")
def e01(spark, sf):
    return cat.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("md5"))


def _frames(spark, sf):
    e = cat.table(spark, sf, "embeddings")
    sixteen = F.flatten(F.array_repeat(F.col("embedding"), 16))
    return e.select(F.col("vec_id").alias("id"), F.transform(sixteen, lambda x, i: F.bround((x.cast("double") + 1) * 100 + i % 37, 0)).alias("gray"))


@query(
    "e02_dct_low",
    "SELECT id, CAST(8 * u + v AS INTEGER) AS k, round(sum(s * cos(pi() * (2 * r + 1) * u / 64)), 3) + 0e0 AS coef FROM across, (SELECT unnest(range(8)) AS u) GROUP BY ALL",
    """gray AS (SELECT vec_id AS id, i, round_even((CAST(embedding[i % len(embedding) + 1] AS DOUBLE) + 1) * 100 + i % 37, 0) AS g FROM embeddings, (SELECT unnest(range(1024)) AS i)),
    across AS (SELECT id, i // 32 AS r, v, sum(g * cos(pi() * (2 * (i % 32) + 1) * v / 64)) AS s FROM gray, (SELECT unnest(range(8)) AS v) GROUP BY ALL)""",
)
def e02(spark, sf):
    c = _frames(spark, sf).select("id", h.dct_low("gray").alias("c"))
    return c.select("id", F.posexplode("c").alias("k", "v")).select("id", "k", (F.round("v", 3) + F.lit(0.0)).alias("coef"))


@query("e03_phash", "SELECT id, phash FROM phash")
def e03(spark, sf):
    return cat.phash(spark, sf)


@query("e02b_phash_of_frames")
def e02b(spark, sf):
    c = _frames(spark, sf).select("id", h.dct_low("gray").alias("c"))
    return h.with_fingerprint(c, "c").select("id", h.hex64(F.col("bits")).alias("phash"))


@query("e04_video_phash", "SELECT id // 4 AS video_id, string_agg(phash, '' ORDER BY id) AS phash FROM phash GROUP BY 1")
def e04(spark, sf):
    rows = cat.phash(spark, sf).groupBy(F.floor(F.col("id") / 4).alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("id", "phash"))).alias("a"))
    return rows.select("video_id", F.array_join(F.transform("a", lambda x: x["phash"]), "").alias("phash"))


def digits_of(view: str, n: int) -> str:
    """SQL of a view ``hx``: the smallest id of each hash of ``view`` and its ``n`` digits as numbers."""
    return f"hx AS (SELECT id, phash, list_transform(range(1, {n + 1}), lambda k: strpos('0123456789abcdef', substr(phash, k, 1)) - 1) AS d FROM (SELECT min(id) AS id, phash FROM {view} WHERE phash IS NOT NULL GROUP BY phash))"


def differing(n: int) -> str:
    return f"CAST(list_sum(list_transform(range(1, {n + 1}), lambda k: bit_count(xor(p.d[k], q.d[k])))) AS INTEGER)"


@query(
    "e05_hamming",
    f"SELECT p.id AS id, {differing(16)} AS distance FROM hx p JOIN hx q ON q.id = p.id + 1",
    "hx AS (SELECT id, phash, list_transform(range(1, 17), lambda k: strpos('0123456789abcdef', substr(phash, k, 1)) - 1) AS d FROM phash)",
)
def e05(spark, sf):
    a = cat.phash(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("phash").alias("other"))
    return a.join(b, "id").select("id", h.hamming_hex(F.col("phash"), F.col("other")).alias("distance"))


@query("e06_similar_pairs", f"SELECT p.id AS id, q.id AS other, {differing(64)} AS distance FROM hx p JOIN hx q ON p.id <> q.id WHERE {differing(64)} <= 20", digits_of("video_hashes", 64))
def e06(spark, sf):
    """Pairs of videos, one for each hash, within 20 of 256 bits."""
    rows = op.hash_classes(cat.video_hashes(spark, sf))
    return op.similar_pairs(rows, rows, 20, 64)


@query("e06b_similar_banded", f"SELECT p.id AS id, q.id AS other, {differing(16)} AS distance FROM hx p JOIN hx q ON p.id <> q.id WHERE {differing(16)} <= 3", digits_of("frame_hashes", 16))
def e06b(spark, sf):
    """Pairs of frames, one for each hash, within 3 of 64 bits."""
    rows = op.hash_classes(cat.frame_hashes(spark, sf))
    return op.similar_pairs(rows, rows, 3, 16)


@query("e06c_hash_classes", "SELECT phash, min(id) AS id, count(*) AS copies FROM frame_hashes WHERE phash IS NOT NULL GROUP BY phash")
def e06c(spark, sf):
    return op.hash_classes(cat.frame_hashes(spark, sf))


#: SQL of a view ``judged`` (id, original, reason) over ``al``: one video after the other, in the order of arrival, against the
#: originals so far. ``kept`` are all of them, ``win`` those with a hash, of which the last 500 count.
JUDGED = (
    """hv AS MATERIALIZED (SELECT id, list_transform(range(1, 65), lambda k: strpos('0123456789abcdef', substr(phash, k, 1)) - 1) AS d FROM al WHERE phash IS NOT NULL),
    ne AS (SELECT p.id AS id, list(q.id) AS near FROM hv p JOIN hv q ON q.id < p.id WHERE """
    + differing(64)
    + """ <= 20 GROUP BY 1),
    sm AS (SELECT p.id AS id, list(q.id) AS same FROM al p JOIN al q ON q.md5 = p.md5 AND q.id < p.id GROUP BY 1),
    arr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY created_at, id) AS n, id, phash IS NOT NULL AS hashed, status = 'skipped' AS gone, coalesce(near, []) AS near, coalesce(same, []) AS same FROM al LEFT JOIN ne USING (id) LEFT JOIN sm USING (id)),
    replay AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS m, CAST(NULL AS BIGINT) AS h, CAST([] AS BIGINT[]) AS kept, CAST([] AS BIGINT[]) AS win
      UNION ALL SELECT n, id, m, h, CASE WHEN gone OR m IS NOT NULL OR h IS NOT NULL THEN kept ELSE list_append(kept, id) END, CASE WHEN gone OR m IS NOT NULL OR h IS NOT NULL OR NOT hashed THEN win ELSE list_append(win, id)[-500:] END
      FROM (SELECT a.n, a.id, gone, hashed, list_filter(kept, lambda u: list_contains(same, u))[1] AS m, list_filter(win, lambda u: list_contains(near, u))[-1] AS h, kept, win FROM replay r JOIN arr a ON a.n = r.n + 1)),
    judged AS (SELECT id, coalesce(m, h) AS original, CASE WHEN m IS NOT NULL THEN 'md5' WHEN h IS NOT NULL THEN 'phash' END AS reason FROM replay WHERE n > 0)"""
)


@query("e07_originals", "SELECT id, original, reason FROM judged", "al AS (SELECT * FROM videos WHERE NOT deleted), " + JUDGED)
def e07(spark, sf):
    return op.originals(alive(cat.videos(spark, sf, hashes=True)))


@query(
    "e08_changed_sentences",
    "SELECT video_id, i, substr(sha256(txt || chr(0) || 'v1' || chr(0) || 'edge' || chr(0) || ''), 1, 16) AS fingerprint, i % 2 = 1 AS changed FROM cues_dst",
)
def e08(spark, sf):
    rows = cat.cues_dst(spark, sf)
    now = rows.select("video_id", "i", h.sentence_fingerprint(F.col("txt"), F.lit("v1"), F.lit("edge"), F.lit(None).cast("string")).alias("fingerprint"))
    old = rows.select("video_id", "i", h.sentence_fingerprint(F.col("txt"), F.when(F.col("i") % 2 == 0, "v1").otherwise("v0"), F.lit("edge"), F.lit("")).alias("before"))
    both = now.join(old, ["video_id", "i"], "left")
    return both.select("video_id", "i", "fingerprint", (F.coalesce("before", F.lit("")) != F.col("fingerprint")).alias("changed"))


@query("e09_fresh_outputs", "SELECT o_orderkey AS id, o_totalprice > 0 AND coalesce(max(l_shipdate) <= o_orderdate + INTERVAL 60 DAY, true) AS usable FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice, o_orderdate")
def e09(spark, sf):
    made = cat.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("at"), F.col("o_totalprice").alias("size"))
    inputs = cat.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("newest"))
    return made.join(inputs, "id", "left").select("id", ((F.col("size") > 0) & F.coalesce(F.col("newest") <= F.col("at"), F.lit(True))).alias("usable"))


@query("e10_distinct_lines")
def e10(spark, sf):
    lines = cat.cues_src(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "i", "txt"))).alias("a"))
    return lines.select("video_id", op.distinct_lines(F.transform("a", lambda x: x["txt"])).alias("n"))


@query(
    "e11_reused_frames",
    "SELECT id, key, reused FROM look",
    """fr AS MATERIALIZED (SELECT vec_id AS id, vec_id // 20 AS key, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 20) AS px FROM embeddings),
    look AS (SELECT id, key, n, px AS held, false AS reused FROM fr WHERE n = 1
      UNION ALL SELECT id, key, n, CASE WHEN same THEN held ELSE px END, same FROM (SELECT f.id, f.key, f.n, f.px, l.held, len(f.px) = len(l.held) AND list_avg(list_transform(range(1, len(f.px) + 1), lambda i: abs(f.px[i] - l.held[i]))) < 3 AS same FROM look l JOIN fr f ON f.key = l.key AND f.n = l.n + 1))""",
)
def e11(spark, sf):
    e = cat.table(spark, sf, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 20).alias("key"), F.col("vec_id").alias("place"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 20).alias("pixels"))
    return op.recomputed(rows).select("id", "key", "reused")
