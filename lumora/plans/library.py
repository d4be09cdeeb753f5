"""Relational queries over the library (listing, counts, lookups, merges)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lumora.operators import library as op
from lumora.operators.order import placed
from lumora.plans.base import STATUSES, query
from lumora.sources import catalog as cat



def newest() -> list:
    return [F.desc("created_at"), F.col("id")]


@query("a01_library_list", "SELECT id, author, title, status FROM videos WHERE NOT deleted AND status = 'review' AND (title ILIKE '%the%' OR author ILIKE '%the%') ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")
def a01(spark, sf):
    return op.page(op.matching(cat.videos(spark, sf), "review", "the"), newest(), 2, 20).select("id", "author", "title", "status")


@query("a02_library_total", "SELECT count(*) AS total FROM videos WHERE NOT deleted AND status = 'review' AND (title ILIKE '%the%' OR author ILIKE '%the%')")
def a02(spark, sf):
    return op.matching(cat.videos(spark, sf), "review", "the").agg(F.count("*").alias("total"))


@query("a03_point_lookup", "SELECT id, author, title, status FROM videos WHERE NOT deleted AND id = 42")
def a03(spark, sf):
    return op.alive(cat.videos(spark, sf)).where("id = 42").select("id", "author", "title", "status")


@query(
    "a04_counts_by_status",
    f"SELECT s.status AS status, count(v.id) AS n FROM (SELECT unnest({list(STATUSES)}) AS status) s LEFT JOIN videos v ON v.status = s.status AND NOT v.deleted GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM videos WHERE NOT deleted",
)
def a04(spark, sf):
    return op.counts_with_zeros(op.alive(cat.videos(spark, sf)), "status", cat.STATUSES)


@query("a05_queue_counts", "SELECT count(*) FILTER (WHERE status = 'running') AS active, count(*) FILTER (WHERE status = 'queued') AS pending FROM videos WHERE NOT deleted")
def a05(spark, sf):
    return op.queue_counts(cat.videos(spark, sf))


@query("a06_existing_keys", "SELECT page_id, CAST(page_id * 3 AS BIGINT) AS key, v.id IS NOT NULL AS known FROM pages LEFT JOIN videos v ON v.id = page_id * 3")
def a06(spark, sf):
    asked = cat.table(spark, sf, "pages").select("page_id", (F.col("page_id") * 3).alias("key"))
    return op.picked(asked, cat.videos(spark, sf).select(F.col("id").alias("key")), "key").select("page_id", "key", F.col("found").alias("known"))


@query("a07_fetch_by_ids", "SELECT o_orderkey AS pos, o_custkey AS id, v.status AS status, v.id IS NOT NULL AS found FROM orders LEFT JOIN videos v ON v.id = o_custkey")
def a07(spark, sf):
    asked = cat.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))
    return op.picked(asked, cat.videos(spark, sf).select("id", "status")).select("pos", "id", "status", "found")


@query("a08_subtitles_of_video", "SELECT i, start_s, end_s, txt, 'zh' AS lang FROM cues_src WHERE video_id = 5 UNION ALL SELECT i, start_s, end_s, txt, 'vi' FROM cues_dst WHERE video_id = 5")
def a08(spark, sf):
    cols = ["i", "start_s", "end_s", "txt"]
    both = [df.where("video_id = 5").select(*cols, F.lit(lang).alias("lang")) for df, lang in ((cat.cues_src(spark, sf), "zh"), (cat.cues_dst(spark, sf), "vi"))]
    return both[0].unionByName(both[1])


@query("a09_job_history", "SELECT id, video_id, step, status, CAST(row_number() OVER (PARTITION BY video_id ORDER BY started_at, id) AS INTEGER) AS place FROM job_runs")
def a09(spark, sf):
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("started_at", "id"))
    return cat.job_runs(spark, sf).select("id", "video_id", "step", "status", place.alias("place"))


@query(
    "a10_exact_duplicate",
    "SELECT v.id AS id, (SELECT arg_min(o.id, (o.created_at, o.id)) FROM videos o WHERE o.md5 = v.md5 AND NOT o.deleted AND o.status <> 'skipped' AND o.id <> v.id) AS original FROM videos v WHERE NOT v.deleted",
)
def a10(spark, sf):
    from lumora.operators.similarity import oldest_same

    return oldest_same(op.alive(cat.videos(spark, sf))).select("id", "original")


@query("a11_recent_candidates", "SELECT id, phash FROM videos WHERE NOT deleted AND phash IS NOT NULL ORDER BY created_at DESC, id LIMIT 100")
def a11(spark, sf):
    return op.alive(cat.videos(spark, sf, hashes=True)).where("phash IS NOT NULL").orderBy(*newest()).limit(100).select("id", "phash")


@query("a16_channel_list", "SELECT id, platform, display_name FROM channels WHERE platform = 'bilibili' AND enabled")
def a16(spark, sf):
    return cat.channels(spark, sf).where("platform = 'bilibili' AND enabled").orderBy(*newest()).select("id", "platform", "display_name")


@query("a17_channel_eligible", "SELECT id, enabled AND license_status IN ('permitted', 'licensed', 'open', 'own') AS auto FROM channels")
def a17(spark, sf):
    return cat.channels(spark, sf).select("id", (F.col("enabled") & F.col("license_status").isin(*cat.AUTO_LICENSES)).alias("auto"))


@query("a18_preset_list", "SELECT id, kind, name, is_default FROM presets WHERE kind = 'process'")
def a18(spark, sf):
    return cat.presets(spark, sf).where("kind = 'process'").orderBy("kind", "name", "id")


@query("a19_sole_default", "SELECT id, kind, is_default AND count(*) FILTER (WHERE is_default) OVER (PARTITION BY kind) = 1 AS sole FROM presets")
def a19(spark, sf):
    others = F.count_if("is_default").over(Window.partitionBy("kind"))
    return cat.presets(spark, sf).select("id", "kind", (F.col("is_default") & (others == 1)).alias("sole"))


@query("a20_clear_other_defaults", "SELECT id, kind, CASE WHEN kind = (SELECT kind FROM presets WHERE id = 50) THEN id = 50 ELSE is_default END AS is_default FROM presets")
def a20(spark, sf):
    return op.defaults_cleared(cat.presets(spark, sf), 50).select("id", "kind", "is_default")


@query("a21_limits_list", "SELECT limits.*, n FROM limits JOIN (SELECT platform, count(*) AS n FROM variants GROUP BY 1) USING (platform)")
def a21(spark, sf):
    """The limits of the platforms that have variants, and how many."""
    used = cat.variants(spark, sf).groupBy("platform").agg(F.count("*").alias("n"))
    return used.join(F.broadcast(cat.limits(spark)), "platform").orderBy("platform")  # 5 fixed rows


@query("a22_unknown_platforms", "SELECT DISTINCT platform FROM channels WHERE platform NOT IN (SELECT platform FROM limits)")
def a22(spark, sf):
    return op.missing(cat.channels(spark, sf), cat.limits(spark).select("platform"), "platform").orderBy("platform")


@query("a23_variants_of_video", "SELECT video_id, platform, part, duration_sec FROM variants WHERE video_id BETWEEN 1 AND 50")
def a23(spark, sf):
    return cat.variants(spark, sf).where("video_id BETWEEN 1 AND 50").orderBy("video_id", "platform", "part").select("video_id", "platform", "part", "duration_sec")


@query("a24_variants_of_alive", "SELECT video_id, platform, part FROM variants WHERE video_id IN (SELECT id FROM videos WHERE NOT deleted)")
def a24(spark, sf):
    parents = op.alive(cat.videos(spark, sf)).select(F.col("id").alias("video_id"))
    return cat.variants(spark, sf).join(parents, "video_id", "left_semi").select("video_id", "platform", "part")


@query("a25_voice_list", "SELECT id, name, CAST(row_number() OVER (ORDER BY NOT is_default, created_at, id) AS INTEGER) AS place FROM voices")
def a25(spark, sf):
    rows = cat.voices(spark, sf).withColumn("other", ~F.col("is_default"))
    return placed(rows, ["other", "created_at", "id"], F.lit(True)).select("id", "name", (F.col("pos") + 1).cast("int").alias("place"))


@query("a26_successor_default", "SELECT arg_min(id, (created_at, id)) AS successor FROM voices WHERE state = 'ready' AND id <> 7")
def a26(spark, sf):
    return cat.voices(spark, sf).where("state = 'ready' AND id <> 7").agg(F.min_by("id", F.struct("created_at", "id")).alias("successor"))


NEW_VARIANTS = "n AS (SELECT video_id, platform, part, duration_sec + 1 AS duration_sec FROM variants WHERE part <= 2 UNION ALL SELECT video_id, platform, 99, 1.0e0 FROM variants WHERE part = 1)"


@query(
    "a27_upsert_variants",
    "SELECT coalesce(n.video_id, o.video_id) AS video_id, coalesce(n.platform, o.platform) AS platform, coalesce(n.part, o.part) AS part, coalesce(n.duration_sec, o.duration_sec) AS duration_sec FROM variants o FULL JOIN n ON o.video_id = n.video_id AND o.platform = n.platform AND o.part = n.part",
    NEW_VARIANTS,
)
def a27(spark, sf):
    old = cat.variants(spark, sf).select("video_id", "platform", "part", "duration_sec")
    again = old.where("part <= 2").withColumn("duration_sec", F.col("duration_sec") + 1)
    more = old.where("part = 1").withColumn("part", F.lit(99)).withColumn("duration_sec", F.lit(1.0))
    return op.upserted(old, again.unionByName(more), ["video_id", "platform", "part"])


@query(
    "a28_upsert_subtitle_unless_edited",
    "SELECT coalesce(o.video_id, n.video_id) AS video_id, coalesce(o.i, n.i + 1) AS i, CASE WHEN o.i IS NOT NULL AND (n.i IS NULL OR o.i % 3 = 0) THEN o.txt ELSE n.txt END AS txt FROM cues_src o FULL JOIN cues_dst n ON o.video_id = n.video_id AND o.i = n.i + 1",
)
def a28(spark, sf):
    old, new = cat.cues_src(spark, sf).select("video_id", "i", "txt"), cat.cues_dst(spark, sf).select("video_id", (F.col("i") + 1).alias("i"), "txt")
    return op.upserted(old, new, ["video_id", "i"], F.col("i") % 3 == 0)


@query("a29_replace_auto_masks", "SELECT id, source, x FROM masks WHERE source <> 'auto' UNION ALL SELECT id + 1000000000, 'auto', x / 2 FROM masks WHERE source = 'auto' AND confidence >= 0.5e0")
def a29(spark, sf):
    old = cat.masks(spark, sf)
    new = old.where("source = 'auto' AND confidence >= 0.5D").select((F.col("id") + 1000000000).alias("id"), "source", (F.col("x") / 2).alias("x"))
    return old.where("source <> 'auto'").select("id", "source", "x").unionByName(new)


@query("a30_masks_by_start", "SELECT id, start_s, end_s FROM masks WHERE video_id = 8")
def a30(spark, sf):
    return cat.masks(spark, sf).where("video_id = 8").orderBy("start_s", "id").select("id", "start_s", "end_s")


@query("a31_limits_of_variants", "SELECT video_id, part, v.platform AS platform, max_sec, title_len FROM variants v JOIN limits USING (platform) WHERE v.platform IN ('tiktok', 'zalo')")
def a31(spark, sf):
    few = cat.limits(spark).where(F.col("platform").isin("tiktok", "zalo"))
    return cat.variants(spark, sf).join(F.broadcast(few), "platform").select("video_id", "part", "platform", "max_sec", "title_len")  # 5 fixed rows


@query("a32_catalog_with_defaults", "SELECT n_nationkey AS code, n_name AS name, coalesce(r_name, 'none') AS base_url, r_regionkey IS NOT NULL AS configured FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def a32(spark, sf):
    saved = cat.table(spark, sf, "region")
    known = cat.table(spark, sf, "nation").join(saved, F.col("r_regionkey") == F.col("n_nationkey"), "left")
    return known.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.coalesce("r_name", F.lit("none")).alias("base_url"), F.col("r_regionkey").isNotNull().alias("configured"))


@query("a34_json_flag_tabs", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 AS waiting FROM events")
def a34(spark, sf):
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.get_json_object("props", "$.k").try_cast("int") > 50).alias("waiting"))


@query("b02_local_frame", "SELECT name, count(c_custkey) AS n FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL), (99, 'none')) AS t(id, name) LEFT JOIN customer ON c_nationkey = id GROUP BY 1")
def b02(spark, sf):
    """Rows of the caller as a frame, counted against a table."""
    own = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (99, "none")], "id long, name string")
    rows = F.broadcast(own).join(cat.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("_n")).agg(F.count("*").alias("n")), F.col("id") == F.col("_n"), "left")
    return rows.groupBy("name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


@query("b12_page_with_total", "SELECT id, count(*) OVER () AS total FROM videos WHERE NOT deleted ORDER BY created_at DESC, id LIMIT 50")
def b12(spark, sf):
    rows = op.alive(cat.videos(spark, sf))
    total = rows.agg(F.count("*").alias("total"))
    return op.page(rows, newest(), 1, 50).select("id").join(F.broadcast(total))  # one row
