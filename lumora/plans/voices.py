"""Queries over dubbed sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import kernels
from lumora.operators import voices as op
from lumora.operators.intervals import with_next_start
from lumora.plans.base import query
from lumora.sources import catalog as cat

SLOTS = """s AS (SELECT *, CASE WHEN nxt IS NULL THEN voice_s ELSE greatest(0e0, nxt - 0.08e0 - start_s) END AS slot FROM (SELECT *, lead(start_s) OVER (PARTITION BY video_id ORDER BY start_s, i) AS nxt FROM cues_dst)),
f AS (SELECT *, CASE WHEN slot <= 0 OR voice_s <= slot THEN 1e0 ELSE greatest(1e0, least(1.5e0, voice_s / slot)) END AS factor FROM s WHERE voice_s > 0)"""


@query("f01_voice_schedule", "SELECT video_id, i, round(slot, 6) AS slot, round(factor, 6) AS factor FROM f", SLOTS)
def f01(spark, sf):
    return op.scheduled(cat.cues_dst(spark, sf)).select("video_id", "i", F.round("slot", 6).alias("slot"), F.round("factor", 6).alias("factor"))


SINGLE = """g AS (SELECT *, nxt IS NULL OR voice_s IS NULL OR voice_s <= 0 AS none FROM (SELECT *, lead(start_s) OVER (PARTITION BY video_id ORDER BY start_s, i) AS nxt FROM cues_dst)),
h AS (SELECT *, CASE WHEN none THEN 0e0 ELSE greatest(0e0, nxt - 0.08e0 - start_s) END AS slot FROM g),
k AS (SELECT *, CASE WHEN none OR slot <= 0 OR voice_s <= slot THEN 1e0 ELSE greatest(1e0, least(1.5e0, voice_s / slot)) END AS factor FROM h)"""


@query("f02_single_slot", "SELECT video_id, i, round(slot, 6) AS slot, round(factor, 6) AS factor, round(CASE WHEN none THEN 0e0 ELSE greatest(0e0, voice_s / factor - slot) END, 6) AS overflow FROM k", SINGLE)
def f02(spark, sf):
    room, factor, over = op.single(F.col("start_s"), F.col("next_start"), F.col("voice_s"))
    return with_next_start(cat.cues_dst(spark, sf)).select("video_id", "i", F.round(room, 6).alias("slot"), F.round(factor, 6).alias("factor"), F.round(over, 6).alias("overflow"))


@query("f03_derived_ends", "SELECT video_id, i, round(voice_s / factor, 6) AS length, round(start_s + voice_s / factor, 6) AS ends FROM f", SLOTS)
def f03(spark, sf):
    return op.scheduled(cat.cues_dst(spark, sf)).select("video_id", "i", F.round("length", 6).alias("length"), F.round("ends", 6).alias("ends"))


@query("c09_sped_up", "SELECT video_id, count(*) FILTER (WHERE factor > 1.01e0) AS n FROM f GROUP BY 1", SLOTS)
def c09(spark, sf):
    return op.scheduled(cat.cues_dst(spark, sf)).groupBy("video_id").agg(F.count_if(F.col("factor") > op.SPED_UP).alias("n"))


@query("c10_problem_counts", "SELECT video_id, count(*) FILTER (WHERE NOT none AND voice_s / factor - slot > 0.05e0) AS overflowing, count(*) FILTER (WHERE factor >= 1.49e0) AS too_fast FROM k GROUP BY 1", SINGLE)
def c10(spark, sf):
    room, factor, over = op.single(F.col("start_s"), F.col("next_start"), F.col("voice_s"))
    rows = with_next_start(cat.cues_dst(spark, sf)).select("video_id", factor.alias("f"), over.alias("o"))
    return rows.groupBy("video_id").agg(F.count_if(F.col("o") > op.OVERFLOW).alias("overflowing"), F.count_if(F.col("f") >= op.AT_LIMIT).alias("too_fast"))


@query(
    "f04_mix_track",
    """SELECT video_id, 128 AS n, round(least(max(abs(v)), 0.99e0), 6) AS peak FROM (
      SELECT video_id, pos, sum(x) AS v FROM (SELECT vec_id // 20 AS video_id, vec_id % 97 + unnest(range(64)) AS pos, unnest(embedding) * 3e0 AS x FROM embeddings) WHERE pos < 128 GROUP BY 1, 2) GROUP BY 1""",
)
def f04(spark, sf):
    seg = cat.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("video_id"), F.struct((F.col("vec_id") % 97).alias("at"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("samples")).alias("s"))
    rows = seg.groupBy("video_id").agg(F.array_sort(F.collect_list("s")).alias("segs"))
    track = rows.select("video_id", kernels.mixed_track(F.lit(128), "segs").alias("t"))
    return track.select("video_id", F.size("t").alias("n"), F.round(F.array_max(F.transform("t", F.abs)), 6).alias("peak"))


def _samples(spark, sf):
    quiet = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.05, F.lit(0.0)).otherwise(x.cast("double")))
    return cat.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), quiet.alias("x"))


LOUD = "q AS (SELECT vec_id AS id, list_filter(range(1, len(embedding) + 1), lambda i: abs(embedding[i]) >= 0.05) AS loud, len(embedding) AS n FROM embeddings)"


@query("f05_trim_silence", "SELECT id, CASE WHEN len(loud) = 0 THEN 0 ELSE n - loud[1] + 1 END AS kept FROM q", LOUD)
def f05(spark, sf):
    return _samples(spark, sf).select("id", F.size(kernels.trimmed(F.col("x"))).cast("long").alias("kept"))


@query("f06_silent_tail", "SELECT id, CASE WHEN len(loud) = 0 THEN n ELSE n - loud[-1] END AS tail FROM q", LOUD)
def f06(spark, sf):
    return _samples(spark, sf).select("id", kernels.silent_tail(F.col("x")).alias("tail"))
