"""Queries over boxes of on-screen text and masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumora.functions.layout import hook_box, safe_area_fits
from lumora.operators import boxes as op
from lumora.plans.base import query
from lumora.sources import catalog as cat

BOX = ("x", "y", "w", "h")


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(
    "g01_iou",
    """SELECT id, round(CASE WHEN iw <= 0 OR ih <= 0 THEN 0e0 ELSE iw * ih / (w * h + pw * ph - iw * ih) END, 6) AS iou FROM (
      SELECT *, least(x + w, px + pw) - greatest(x, px) AS iw, least(y + h, py + ph) - greatest(y, py) AS ih FROM (
        SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM boxes WINDOW o AS (PARTITION BY video_id ORDER BY time)) WHERE px IS NOT NULL)""",
)
def g01(spark, sf):
    w = Window.partitionBy("video_id").orderBy("time")
    rows = cat.boxes(spark, sf).withColumns({f"p{c}": F.lag(c).over(w) for c in BOX}).where("px IS NOT NULL")
    return rows.select("id", F.round(op.iou({c: F.col(c) for c in BOX}, {c: F.col(f"p{c}") for c in BOX}), 6).alias("iou"))


@query(
    "g02_quad_to_box",
    "SELECT id, round(a, 6) AS x, round(t, 6) AS y, round(least(1, r) - a, 6) AS w, round(least(1, d) - t, 6) AS h FROM (SELECT id, least(1, x) AS a, least(1, y + 0.01e0) AS t, x + w + 0.02e0 AS r, y + h + 0.04e0 AS d FROM boxes)",
)
def g02(spark, sf):
    x, y, r, d = F.col("x") * 100, F.col("y") * 100, (F.col("x") + F.col("w")) * 100, (F.col("y") + F.col("h")) * 100
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = cat.boxes(spark, sf).select("id", op.quad_box(F.array(p(x, y + 1), p(r, y + 2), p(r + 2, d + 3), p(x + 1, d + 4)), F.lit(100), F.lit(100)).alias("q"))
    return rows.select("id", *[F.round(f"q.{c}", 6).alias(c) for c in BOX])


@query("g03_confidence_filter", "SELECT id, confidence FROM boxes WHERE confidence >= 0.45e0")
def g03(spark, sf):
    return cat.boxes(spark, sf).where(F.col("confidence") >= op.LEAST_CONFIDENCE).select("id", "confidence")


def _tracks(spark, sf):
    return op.tracked(cat.boxes(spark, sf).where(F.col("confidence") >= op.LEAST_CONFIDENCE))


@query(
    "g04_track_boxes",
    "SELECT video_id, id, CAST(t AS BIGINT) - 1 AS track FROM go",
    """b AS MATERIALIZED (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY time, y, x, id) AS n, {'l': x, 't': y, 'r': x + w, 'b': y + h} AS p FROM boxes WHERE confidence >= 0.45e0),
    go AS (SELECT video_id, id, n, 1 AS t, [{'last': p, 'lo': p.t, 'hi': p.b, 'tall': (p.b - p.t) * 1.8e0}] AS ts FROM b WHERE n = 1
      UNION ALL SELECT video_id, id, n, coalesce(t, len(ts) + 1), CASE WHEN t IS NULL THEN list_append(ts, {'last': p, 'lo': p.t, 'hi': p.b, 'tall': (p.b - p.t) * 1.8e0})
          ELSE list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN i = t THEN {'last': p, 'lo': least(ts[i].lo, p.t), 'hi': greatest(ts[i].hi, p.b), 'tall': ts[i].tall} ELSE ts[i] END) END
      FROM (SELECT video_id, id, n, p, ts, list_min(list_filter(range(1, len(ts) + 1), lambda i: shared[i] > 0 AND shared[i] / ((ts[i].last.r - ts[i].last.l) * (ts[i].last.b - ts[i].last.t) + (p.r - p.l) * (p.b - p.t) - shared[i]) >= 0.45e0 AND greatest(ts[i].hi, p.b) - least(ts[i].lo, p.t) <= ts[i].tall)) AS t
        FROM (SELECT b.video_id, b.id, b.n, b.p, g.ts, list_transform(g.ts, lambda s: greatest(0, least(s.last.r, b.p.r) - greatest(s.last.l, b.p.l)) * greatest(0, least(s.last.b, b.p.b) - greatest(s.last.t, b.p.t))) AS shared FROM go g JOIN b ON b.video_id = g.video_id AND b.n = g.n + 1)))""",
)
def g04(spark, sf):
    return _tracks(spark, sf).select("video_id", "id", "track")


TRACK = "tr AS (SELECT *, id % 7 AS track FROM boxes)"


def _given(spark, sf):
    return cat.boxes(spark, sf).withColumn("track", F.col("id") % 7)


@query(
    "g05_track_measures",
    "SELECT video_id, track, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h, min(time) AS start_s, max(time) AS end_s, count(*) AS n, round(avg(confidence), 6) AS confidence FROM tr GROUP BY 1, 2",
    TRACK,
)
def g05(spark, sf):
    return op.track_measures(_given(spark, sf)).select("video_id", "track", *six(*BOX), "start_s", "end_s", "n", *six("confidence"))




@query(
    "g06_han_share",
    "SELECT id, round(CASE WHEN length(b) = 0 THEN 0e0 ELSE length(regexp_replace(b, '[^一-鿿㐀-䶿]', '', 'g')) / CAST(length(b) AS DOUBLE) END, 6) AS han FROM (SELECT event_id AS id, regexp_replace(CASE event_id % 4 WHEN 0 THEN '你好 ' || props WHEN 1 THEN '字幕' WHEN 2 THEN ' ' ELSE props END, '\\s', '', 'g') AS b FROM events)",
)
def g06(spark, sf):
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit("你好 "), "props")).when(k == 1, "字幕").when(k == 2, " ").otherwise(F.col("props"))
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(op.han_share(t), 6).alias("han"))


SIGNS = "CASE id % 4 WHEN 0 THEN '你好 ' || txt WHEN 1 THEN '字幕' WHEN 2 THEN ' ' ELSE txt END"


@query(
    "g07_language_gate",
    """SELECT video_id, track, count(*) >= 2 AND (max(han) >= 0.3e0 OR count(DISTINCT said) >= 3) AS passes FROM (
      SELECT *, CASE WHEN length(b) = 0 THEN 0e0 ELSE length(regexp_replace(b, '[^一-鿿㐀-䶿]', '', 'g')) / CAST(length(b) AS DOUBLE) END AS han
      FROM (SELECT *, regexp_replace(said, '\\s', '', 'g') AS b FROM signs)) GROUP BY 1, 2""",
    f"signs AS (SELECT video_id, id % 7 AS track, CASE WHEN id % 7 < 5 THEN {SIGNS} ELSE 'stop ' || id % 3 END AS said FROM boxes)",
)
def g07(spark, sf):
    k, track = F.col("id") % 4, F.col("id") % 7
    said = F.when(k == 0, F.concat(F.lit("你好 "), "txt")).when(k == 1, "字幕").when(k == 2, " ").otherwise(F.col("txt"))
    rows = cat.boxes(spark, sf).select("video_id", track.alias("track"), F.when(track < 5, said).otherwise(F.concat(F.lit("stop "), F.col("id") % 3)).alias("said"))
    m = rows.groupBy("video_id", "track").agg(F.count("*").alias("n"), F.max(op.han_share(F.col("said"))).alias("han"), F.countDistinct("said").alias("lines"))
    return m.select("video_id", "track", op.gate().alias("passes"))


#: Texts of which all and half the characters are Han.
SAID = ("你好世界", "字幕ab")


@query(
    "g08_score",
    f"""SELECT video_id, track, round(1.6e0 * least(1, n / 4e0) + CASE WHEN n > 1 AND k > 1 THEN 1.2e0 * (k - 1) / (n - 1) ELSE 0 END + 0.6e0 * least(1, greatest(0, (c - 0.45e0) / 0.55e0)) + CASE WHEN cy BETWEEN 0.25e0 AND 0.92e0 THEN 0.5e0 ELSE 0 END + han, 6) AS score
    FROM (SELECT video_id, track, count(*) AS n, count(DISTINCT CASE WHEN said <> ' ' THEN said END) AS k, avg(confidence) AS c, min(y) + (max(y + h) - min(y)) / 2 AS cy, max(CASE said WHEN '{SAID[0]}' THEN 1e0 WHEN '{SAID[1]}' THEN 0.5e0 ELSE 0e0 END) AS han
      FROM (SELECT *, CASE (id * 31 + id // 7) % 4 WHEN 0 THEN CASE WHEN track < 3 THEN '{SAID[0]}' ELSE 'qrs' END WHEN 1 THEN CASE WHEN track < 5 THEN '{SAID[1]}' ELSE 'qrs' END WHEN 2 THEN 'klmnop' ELSE ' ' END AS said FROM tr) GROUP BY 1, 2)""",
    TRACK,
)
def g08(spark, sf):
    """Scores from the measures of tracks whose texts differ, blank ones among them, with and without Han characters."""
    k, track = (F.col("id") * 31 + F.floor(F.col("id") / 7)) % 4, F.col("track")
    said = F.when(k == 0, F.when(track < 3, SAID[0]).otherwise("qrs")).when(k == 1, F.when(track < 5, SAID[1]).otherwise("qrs")).when(k == 2, "klmnop").otherwise(" ")
    m = op.track_measures(_given(spark, sf).withColumn("txt", said))
    return op.scored(m).select("video_id", "track", F.round("score", 6).alias("score"))


@query(
    "g09_dilate",
    "SELECT id, round(l, 6) AS x, round(t, 6) AS y, round(least(1, x + w + p) - l, 6) AS w, round(least(1, y + h + p) - t, 6) AS h, greatest(0, start_s - 0.25e0) AS start_s, end_s + 0.25e0 AS end_s FROM (SELECT *, greatest(0, x - p) AS l, greatest(0, y - p) AS t FROM (SELECT *, greatest(0.006e0, h * 0.35e0) AS p FROM masks))",
)
def g09(spark, sf):
    return op.dilated(cat.masks(spark, sf)).select("id", *six(*BOX), "start_s", "end_s")


def _regions(spark, sf):
    rows = cat.masks(spark, sf)
    return rows.withColumn("score", F.col("confidence") * 4).withColumn("reasons", F.array("source"))


@query("g10_bridge_gaps")
def g10(spark, sf):
    return op.folded(op.dilated(_regions(spark, sf)), op.bridge).select("video_id", *six(*BOX), "start_s", "end_s", F.round("score", 6).alias("score"))


@query(
    "g11_merge_regions",
    "SELECT video_id, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h, min(start_s) AS start_s, max(end_s) AS end_s, round(max(confidence), 6) AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS reasons FROM masks GROUP BY 1",
)
def g11(spark, sf):
    """All masks of a video merged, two at a time."""
    rows = cat.masks(spark, sf).withColumn("score", F.col("confidence")).withColumn("reasons", F.array("source"))
    one = op.folded(rows, lambda regions: [reduce(op.Region.with_, regions)])
    return one.select("video_id", *six(*BOX), "start_s", "end_s", F.round("score", 6).alias("score"), F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


@query("g12_merge_overlapping")
def g12(spark, sf):
    return op.folded(op.dilated(_regions(spark, sf)), op.merge).select("video_id", *six(*BOX), "start_s", "end_s", F.round("score", 6).alias("score"))


@query("g13_drop_oversize", "SELECT id FROM (SELECT id, w, h * (1 + id % 5) AS h FROM masks) WHERE h <= 0.14e0 AND w * h <= 0.2e0")
def g13(spark, sf):
    return op.not_oversize(cat.masks(spark, sf).withColumn("h", F.col("h") * (1 + F.col("id") % 5))).select("id")


@query(
    "g14_touching_components",
    "SELECT a AS id, min(b) AS component FROM reach GROUP BY 1",
    """m AS (SELECT * FROM masks), e AS (SELECT p.id AS a, q.id AS b FROM m p JOIN m q ON p.video_id = q.video_id AND p.x < q.x + q.w AND q.x < p.x + p.w AND p.y < q.y + q.h AND q.y < p.y + p.h),
    reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)""",
)
def g14(spark, sf):
    return op.touching(cat.masks(spark, sf), "video_id").select("id", "component")


@query(
    "g15_pixels",
    "SELECT id, greatest(0, CAST(floor(x * 720) AS BIGINT) - 12) AS px_left, greatest(0, CAST(floor(y * 1280) AS BIGINT) - 12) AS px_top, least(720, CAST(floor((x + w) * 720) AS BIGINT) + 12) AS px_right, least(1280, CAST(floor((y + h) * 1280) AS BIGINT) + 12) AS px_bottom FROM masks",
)
def g15(spark, sf):
    return op.pixels(cat.masks(spark, sf), 720, 1280).select("id", "px_left", "px_top", "px_right", "px_bottom")


@query(
    "g16_safe_area",
    "SELECT id, platform, CAST(round_even(sa_bottom * 1920, 0) AS INTEGER) AS margin_v, CAST(round_even(1080 * (1 - sa_left - sa_right), 0) AS INTEGER) AS line_width, x >= sa_left AND y >= sa_top AND x + w <= 1 - sa_right AND y + h <= 1 - sa_bottom AS fits FROM boxes JOIN limits ON platform = CASE id % 5 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'youtube' WHEN 2 THEN 'facebook' WHEN 3 THEN 'instagram' ELSE 'zalo' END",
)
def g16(spark, sf):
    """Whether each box keeps to the safe area of a platform, and the margins there."""
    rows = cat.boxes(spark, sf).withColumn("platform", cat.choice(F.col("id"), ("tiktok", "youtube", "facebook", "instagram", "zalo")))
    return rows.join(F.broadcast(cat.limits(spark)), "platform").select(  # 5 fixed rows
        "id", "platform", F.bround(F.col("sa_bottom") * 1920, 0).cast("int").alias("margin_v"), F.bround(1080 * (1 - F.col("sa_left") - F.col("sa_right")), 0).cast("int").alias("line_width"),
        safe_area_fits({c: F.col(c) for c in BOX}).alias("fits"),
    )


@query("g17_hook_box", "SELECT video_id, part, platform, sa_left AS x, sa_top AS y, round(greatest(0, 1 - sa_left - sa_right), 6) AS w, round(least(0.14e0, greatest(0, 1 - sa_top - sa_bottom)), 6) AS h FROM variants JOIN limits USING (platform)")
def g17(spark, sf):
    """The hook's box on each variant."""
    x, y, w, h = hook_box()
    return cat.variants(spark, sf).join(F.broadcast(cat.limits(spark)), "platform").select("video_id", "part", "platform", x.alias("x"), y.alias("y"), F.round(w, 6).alias("w"), F.round(h, 6).alias("h"))


@query("g19_mask_timeline")
def g19(spark, sf):
    return op.mask_timeline(_regions(spark, sf)).select("video_id", *six(*BOX), "start_s", "end_s", F.round("score", 6).alias("score"))


@query("i03_detect_masks")
def i03(spark, sf):
    said = F.element_at(F.array(*[F.lit(x) for x in ("字幕出现", "第二行字", "stop 2ama", "新的一句话")]), (F.col("id") % 4 + 1).cast("int"))
    han = op.tracked(cat.boxes(spark, sf).where(F.col("confidence") >= op.LEAST_CONFIDENCE).withColumn("txt", said))
    m = op.scored(op.track_measures(han).where(op.gate())).where(F.col("score") > op.SCORE)
    return op.mask_timeline(m).select("video_id", *six(*BOX), "start_s", "end_s", F.round("score", 6).alias("score"), "reasons")
