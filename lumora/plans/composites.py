"""End-to-end queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumora.operators import intervals, library, similarity, voices
from lumora.operators import states
from lumora.plans.base import query
from lumora.plans.intervals import segment_views
from lumora.plans.similarity import JUDGED
from lumora.plans.voices import SINGLE
from lumora.sources import catalog as cat

ALIGN = "al AS (SELECT d.video_id AS v, d.i AS di, coalesce(string_agg(s.txt, ' / ' ORDER BY s.start_s, s.i), '') AS source FROM cues_dst d LEFT JOIN cues_src s ON s.video_id = d.video_id AND s.start_s < d.end_s AND s.end_s > d.start_s GROUP BY 1, 2)"


@query(
    "i01_review_table",
    "SELECT video_id, i, start_s, end_s, txt, source, i % 5 = 0 AS edited, round(voice_s, 6) AS voice_s, round(slot, 6) AS slot, round(factor, 6) AS factor, round(CASE WHEN none THEN 0e0 ELSE greatest(0e0, voice_s / factor - slot) END, 6) AS overflow FROM k JOIN al ON v = video_id AND di = i",
    f"{ALIGN}, {SINGLE}",
)
def review_table(spark, sf):
    """Translated cues beside their source, with the room and speed of each voice."""
    rows = intervals.with_next_start(intervals.aligned(cat.cues_dst(spark, sf), cat.cues_src(spark, sf)))
    room, factor, over = voices.single(F.col("start_s"), F.col("next_start"), F.col("voice_s"))
    return rows.select(
        "video_id", "i", "start_s", "end_s", "txt", "source", (F.col("i") % 5 == 0).alias("edited"), F.round("voice_s", 6).alias("voice_s"),
        F.round(room, 6).alias("slot"), F.round(factor, 6).alias("factor"), F.round(over, 6).alias("overflow"),
    )


@query("i01b_review_untranslated", "SELECT video_id, i, start_s, end_s, '' AS txt, txt AS source, 0e0 AS slot, 1e0 AS factor, 0e0 AS overflow FROM cues_src WHERE video_id % 2 = 0")
def review_untranslated(spark, sf):
    """Videos without a translation: their source cues as the frame of the table."""
    dst = cat.cues_dst(spark, sf).where("video_id % 2 = 1").select("video_id").distinct()
    rows = cat.cues_src(spark, sf).join(dst, "video_id", "left_anti")
    return rows.select("video_id", "i", "start_s", "end_s", F.lit("").alias("txt"), F.col("txt").alias("source"), F.lit(0.0).alias("slot"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("overflow"))


@query("i02_retranslate_selection", "SELECT video_id, i, CASE WHEN i % 5 = 0 THEN txt ELSE 'new ' || source END AS txt FROM cues_dst JOIN al ON v = video_id AND di = i WHERE i % 2 = 0 AND source <> ''", ALIGN)
def retranslate_selection(spark, sf):
    """Selected cues with their source text, new texts merged in; cues without a source are left out."""
    dst = cat.cues_dst(spark, sf).where("i % 2 = 0")
    chosen = intervals.aligned(dst, cat.cues_src(spark, sf)).where("source <> ''").withColumn("edited", F.col("i") % 5 == 0)
    new = chosen.select("video_id", "i", F.concat(F.lit("new "), "source").alias("new_txt"))
    return states.retranslated(chosen.select("video_id", "i", "txt", "edited"), new).select("video_id", "i", "txt")


SLOT = """s AS (SELECT *, CASE WHEN nxt IS NULL THEN voice_s ELSE greatest(0e0, nxt - 0.08e0 - start_s) END AS slot FROM (SELECT *, lead(start_s) OVER (PARTITION BY video_id ORDER BY start_s, i) AS nxt FROM cues_dst)),
f AS (SELECT *, CASE WHEN slot <= 0 OR voice_s <= slot THEN 1e0 ELSE greatest(1e0, least(1.5e0, voice_s / slot)) END AS factor FROM s WHERE voice_s > 0)"""


@query("i04_dub_plan", "SELECT video_id, count(*) AS segments, count(*) FILTER (WHERE factor > 1.01e0) AS sped_up, round(max(start_s + voice_s / factor) + 2, 6) AS total_s FROM f GROUP BY 1", SLOT)
def dub_plan(spark, sf):
    """Segments, sped-up ones and the length of each video's dub."""
    rows = voices.scheduled(cat.cues_dst(spark, sf)).groupBy("video_id")
    return rows.agg(F.count("*").alias("segments"), F.count_if(F.col("factor") > voices.SPED_UP).alias("sped_up"), F.round(F.max("ends") + 2, 6).alias("total_s"))


@query(
    "i05_variants",
    "SELECT coalesce(s.video_id, v.video_id) AS video_id, coalesce(s.platform, v.platform) AS platform, coalesce(s.part, v.part) AS part, coalesce(round(s.hi - s.lo, 6), v.duration_sec) AS duration_sec FROM (SELECT * FROM seg WHERE part > 0) s FULL JOIN variants v ON v.video_id = s.video_id AND v.platform = s.platform AND v.part = s.part",
    segment_views("CASE platform WHEN 'facebook' THEN 90e0 ELSE 180e0 END", "(VALUES ('tiktok'), ('facebook')) AS p(platform)"),
)
def variants(spark, sf):
    """Parts of each video for its targets, written over the known variants."""
    cues = cat.cues_src(spark, sf)
    length = cues.groupBy("video_id").agg((F.max("end_s") * 20).alias("duration_sec"))
    cuts = intervals.silence_cuts(cues).select("video_id", (F.col("cut") * 20).alias("cut"))
    targets = length.select("video_id", F.explode(F.array(F.lit("tiktok"), F.lit("facebook"))).alias("platform"))
    lim = cat.limits(spark).withColumn("max_sec", F.when(F.col("platform") == "facebook", 90).otherwise(180))
    plan = intervals.parts(length, cuts, lim, targets).select("video_id", "platform", "part", F.round(F.col("end_s") - F.col("start_s"), 6).alias("duration_sec"))
    return library.upserted(cat.variants(spark, sf).select("video_id", "platform", "part", "duration_sec"), plan, ["video_id", "platform", "part"])


@query(
    "i06_ingest_dedup",
    "SELECT al.id AS id, md5, original, reason, CASE WHEN original IS NOT NULL THEN 'skipped' ELSE status END AS new_status FROM al JOIN judged ON judged.id = al.id",
    "al AS (SELECT * FROM videos WHERE NOT deleted), " + JUDGED,
)
def ingest_dedup(spark, sf):
    """Each video judged when it arrives: copies of an earlier original, exact or else perceptual, are marked as skipped."""
    rows = library.alive(cat.videos(spark, sf, hashes=True))
    told = rows.select("id", "md5", "status").join(similarity.originals(rows), "id")
    return told.select("id", "md5", "original", "reason", F.when(F.col("original").isNotNull(), "skipped").otherwise(F.col("status")).alias("new_status"))


@query(
    "i07_usage_dashboard",
    "SELECT service, count(*) AS calls, round(sum(cost_usd), 6) AS usd, round(sum(cost_usd) / sum(sum(cost_usd)) OVER (), 6) AS share FROM cost_logs GROUP BY 1",
)
def usage_dashboard(spark, sf):
    """Calls, spend and share of spend by service."""
    by = cat.cost_logs(spark, sf).groupBy("service").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("_u"))
    return by.select("service", "calls", F.round("_u", 6).alias("usd"), F.round(F.col("_u") / F.sum("_u").over(Window.partitionBy(F.lit(1))), 6).alias("share"))
