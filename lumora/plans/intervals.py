"""Queries over cues: alignment, formatting, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import subtitles as sub
from lumora.operators import intervals as op
from lumora.plans.base import query
from lumora.sources import catalog as cat


def cue_arrays(cues):
    """(video_id, cues): each video's cues in order as one array."""
    c = F.struct("start_s", F.col("i"), "end_s", "txt")
    rows = cues.groupBy("video_id").agg(F.array_sort(F.collect_list(c)).alias("a"))
    return rows.select("video_id", F.transform("a", lambda x: sub.cue(x["i"], x["start_s"], x["end_s"], x["txt"])).alias("cues"))


def exploded(rows, extra=()):
    return rows.select("video_id", F.explode("cues").alias("c")).select("video_id", "c.i", F.round("c.start", 6).alias("start_s"), F.round("c.end", 6).alias("end_s"), F.col("c.text").alias("txt"))


@query(
    "d01_overlap_align",
    "SELECT d.video_id, d.i, coalesce(string_agg(s.txt, ' / ' ORDER BY s.start_s, s.i), '') AS source, CAST(count(s.i) AS INTEGER) AS n_source FROM cues_dst d LEFT JOIN cues_src s ON s.video_id = d.video_id AND s.start_s < d.end_s AND s.end_s > d.start_s GROUP BY d.video_id, d.i",
)
def d01(spark, sf):
    return op.aligned(cat.cues_dst(spark, sf), cat.cues_src(spark, sf)).select("video_id", "i", "source", "n_source")


@query(
    "d02_merge_short",
    "SELECT video_id, arg_min(i, k) AS i, round(arg_min(start_s, k), 6) AS start_s, round(arg_max(end_s, k), 6) AS end_s, trim(string_agg(txt, ' ' ORDER BY k)) AS txt FROM (SELECT * REPLACE (CASE WHEN g = last AND NOT closed AND g > 1 THEN g - 1 ELSE g END AS g) FROM (SELECT *, max(g) OVER w AS last, last_value(shut) OVER (w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closed FROM run WINDOW w AS (PARTITION BY video_id))) GROUP BY video_id, g",
    """c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s, i) AS k FROM cues_src),
    run AS (SELECT *, CAST(1 AS BIGINT) AS g, start_s AS since, NOT end_s - start_s < 0.9e0 AS shut FROM c WHERE k = 1
      UNION ALL SELECT video_id, i, start_s, end_s, txt, k, g, since, NOT end_s - since < 0.9e0 FROM (SELECT c.*, CASE WHEN r.shut THEN r.g + 1 ELSE r.g END AS g, CASE WHEN r.shut THEN c.start_s ELSE r.since END AS since FROM run r JOIN c ON c.video_id = r.video_id AND c.k = r.k + 1))""",
)
def d02(spark, sf):
    return exploded(cue_arrays(cat.cues_src(spark, sf)).select("video_id", sub.merged_short(F.col("cues"), 0.9).alias("cues")))


@query("d03_clean", "SELECT video_id, i, trim(regexp_replace(txt, '\\s+', ' ', 'g')) AS txt FROM cues_src WHERE trim(regexp_replace(txt, '\\s+', ' ', 'g')) <> ''")
def d03(spark, sf):
    return cat.cues_src(spark, sf).select("video_id", "i", sub.squeezed(F.col("txt")).alias("txt")).where("txt <> ''")


@query("d04_split_long")
def d04(spark, sf):
    return exploded(cue_arrays(cat.cues_src(spark, sf)).select("video_id", sub.split_long(12, 1, 0.5)("cues").alias("cues")))


@query(
    "d05_pack_words",
    "SELECT conv_id, turn, CAST(g AS BIGINT) AS k, string_agg(w, ' ' ORDER BY k) AS piece FROM run GROUP BY conv_id, turn, g UNION ALL SELECT conv_id, turn, CAST(0 AS BIGINT), txt FROM t WHERE NOT cut",
    """t AS MATERIALIZED (SELECT *, length(txt) * 1e0 / wanted AS aim, length(txt) > 84 AND wanted > 1 AS cut, string_split(txt, ' ') AS ws FROM (SELECT *, least(CAST(ceil(length(txt) / 84e0) AS BIGINT), 833) AS wanted FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS txt FROM conversations))),
    w AS MATERIALIZED (SELECT conv_id, turn, aim, greatest(84e0, aim) AS top, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM t WHERE cut),
    m AS MATERIALIZED (SELECT *, length(w) AS n, regexp_matches(w, '[。.！!？?；;，,、]$') AS stop FROM w),
    run AS (SELECT conv_id, turn, k, w, 0 AS g, n AS size, n >= aim OR (stop AND n >= aim * 0.6e0) AS shut FROM m WHERE k = 0
      UNION ALL SELECT conv_id, turn, k, w, g, size, size >= aim OR (stop AND size >= aim * 0.6e0) FROM (
        SELECT m.*, CASE WHEN r.shut OR r.size + 1 + m.n > m.top THEN r.g + 1 ELSE r.g END AS g, CASE WHEN r.shut OR r.size + 1 + m.n > m.top THEN m.n ELSE r.size + 1 + m.n END AS size
        FROM run r JOIN m ON m.conv_id = r.conv_id AND m.turn = r.turn AND m.k = r.k + 1))""",
)
def d05(spark, sf):
    rows = cat.table(spark, sf, "conversations").select("conv_id", "turn", sub.cue(F.col("turn"), F.lit(0.0), F.lit(1000.0), sub.squeezed(F.col("text"))).alias("c"))
    cut = rows.select("conv_id", "turn", F.explode(sub.split_long(42, 2, 1.2)(F.array("c"))).alias("p"))
    return cut.select("conv_id", "turn", F.col("p.i").alias("k"), F.col("p.text").alias("piece"))


@query(
    "d06_spread_by_characters",
    """SELECT video_id, i, k, round(s + (e - s) * (done - n) / total, 9) AS piece_start, round(CASE WHEN k = last THEN e ELSE s + (e - s) * done / total END, 9) AS piece_end FROM (
      SELECT *, length(w) AS n, sum(length(w)) OVER (PARTITION BY video_id, i ORDER BY k) AS done, sum(length(w)) OVER (PARTITION BY video_id, i) AS total, max(k) OVER (PARTITION BY video_id, i) AS last FROM (
        SELECT video_id, i, start_s AS s, end_s AS e, k, string_split(txt, ' ')[k + 1] AS w FROM (SELECT *, CAST(unnest(range(len(string_split(txt, ' ')))) AS INTEGER) AS k FROM cues_src)))
    WHERE total > 0""",
)
def d06(spark, sf):
    rows = cat.cues_src(spark, sf).select("video_id", "i", "start_s", "end_s", F.posexplode(F.split("txt", " ")).alias("k", "text"))
    got = op.spread(rows, ["video_id", "i"]).where("piece_start IS NOT NULL")
    return got.select("video_id", "i", "k", F.round("piece_start", 9).alias("piece_start"), F.round("piece_end", 9).alias("piece_end"))


@query(
    "d07_wrap",
    """SELECT conv_id, turn, CASE WHEN len(w) <= n THEN array_to_string(w, ' ') ELSE array_to_string(w[1:n], ' ') || chr(10) || array_to_string(w[n + 1:], ' ') END AS txt FROM (
      SELECT conv_id, turn, w, greatest(1, len(list_filter(range(1, len(w) + 1), lambda k: length(array_to_string(w[1:k], ' ')) <= 42))) AS n
      FROM (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM conversations))""",
)
def d07(spark, sf):
    return cat.table(spark, sf, "conversations").select("conv_id", "turn", sub.wrapped(F.col("text"), 42, 2).alias("txt"))


def to_3(x: str) -> str:
    """SQL that rounds the decimal form of a double half to even."""
    return f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 17)), 3) AS DOUBLE)"


def repaired_end(start: str) -> str:
    return f"CASE WHEN nx IS NOT NULL AND greatest(e, {start} + 1.2e0) > nx - 0.04e0 THEN greatest({start} + 0.3e0, nx - 0.04e0) ELSE greatest(e, {start} + 1.2e0) END"


@query(
    "d08_enforce_timing",
    "SELECT video_id, i, s AS start_s, e AS end_s, txt FROM repaired",
    f"""c AS (SELECT video_id, i, txt, row_number() OVER w AS k, start_s AS s, end_s AS e, lead(start_s) OVER w AS nx FROM cues_src WINDOW w AS (PARTITION BY video_id ORDER BY start_s, i)),
    repaired AS (
      SELECT video_id, k, i, txt, {to_3('s')} AS s, {to_3(repaired_end('s'))} AS e FROM c WHERE k = 1
      UNION ALL
      SELECT video_id, k, i, txt, {to_3('b')}, {to_3(repaired_end('b'))}
      FROM (SELECT c.*, greatest(c.s, r.e + 0.04e0) AS b FROM repaired r JOIN c ON c.video_id = r.video_id AND c.k = r.k + 1))""",
)
def d08(spark, sf):
    return exploded(cue_arrays(cat.cues_src(spark, sf)).select("video_id", sub.timed(F.col("cues")).alias("cues")))


@query("d09_format_cues")
def d09(spark, sf):
    return exploded(sub.formatted(cue_arrays(cat.cues_src(spark, sf)), "cues", 12, 2))


@query("d10_silence_cuts", "SELECT video_id, round((end_s + nxt) / 2, 6) AS cut FROM (SELECT *, lead(start_s) OVER (PARTITION BY video_id ORDER BY start_s, i) AS nxt FROM cues_src) WHERE nxt - end_s >= 0.35e0")
def d10(spark, sf):
    return op.silence_cuts(cat.cues_src(spark, sf)).select("video_id", F.round("cut", 6).alias("cut"))


def _lengths(spark, sf):
    return cat.cues_src(spark, sf).groupBy("video_id").agg((F.max("end_s") * 20).alias("duration_sec"))


def _wide_cuts(spark, sf):
    return op.silence_cuts(cat.cues_src(spark, sf)).select("video_id", (F.col("cut") * 20).alias("cut"))


def segment_views(mx: str, of: str) -> str:
    """SQL of ``seg``: the parts of each video of ``of`` (video_id, platform) with at most ``mx`` seconds each."""
    return f"""sil AS (SELECT video_id, end_s, lead(start_s) OVER (PARTITION BY video_id ORDER BY start_s, i) AS nxt FROM cues_src),
    cut AS (SELECT video_id, list((end_s + nxt) / 2 * 20) AS cuts FROM sil WHERE nxt - end_s >= 0.35e0 GROUP BY 1),
    dur AS (SELECT video_id, max(end_s) * 20 AS total FROM cues_src GROUP BY 1),
    seg AS (
      SELECT video_id, platform, {mx} AS mx, total, coalesce(cuts, []) AS cuts, 0 AS part, 0e0 AS lo, 0e0 AS hi FROM dur LEFT JOIN cut USING (video_id), {of}
      UNION ALL
      SELECT video_id, platform, mx, total, cuts, part + 1, hi, CASE WHEN total - hi <= mx THEN total ELSE coalesce(list_max(list_filter(cuts, lambda p: p > hi AND p <= bound AND p > 0 AND p < total)), bound) END
      FROM (SELECT *, CASE WHEN total - (hi + mx) > 0 AND total - (hi + mx) < 10 THEN total - 10 ELSE hi + mx END AS bound FROM seg WHERE hi < total))"""


@query("d11_segments", "SELECT video_id, part, round(hi, 6) AS end_s FROM seg WHERE part > 0", segment_views("90e0", "(VALUES ('any')) AS p(platform)"))
def d11(spark, sf):
    cuts = _wide_cuts(spark, sf).groupBy("video_id").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    rows = _lengths(spark, sf).join(cuts, "video_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    ends = rows.select("video_id", op.part_bounds(F.col("duration_sec"), F.lit(90), F.col("cuts")).alias("ends"))
    return ends.select("video_id", F.posexplode("ends").alias("p", "end_s")).select("video_id", (F.col("p") + 1).alias("part"), F.round("end_s", 6).alias("end_s"))


@query(
    "d12_variant_plan",
    "SELECT video_id, platform, part, CAST(count(*) OVER (PARTITION BY video_id, platform) AS INTEGER) AS part_total, round(lo, 6) AS start_s, round(hi, 6) AS end_s FROM seg WHERE part > 0",
    segment_views("CASE platform WHEN 'facebook' THEN 90e0 ELSE 180e0 END", "(VALUES ('tiktok'), ('youtube'), ('facebook')) AS p(platform)"),
)
def d12(spark, sf):
    lim = cat.limits(spark).withColumn("max_sec", F.when(F.col("platform") == "facebook", 90).otherwise(180))
    length = _lengths(spark, sf)
    targets = length.select("video_id", F.explode(F.array(*[F.lit(p) for p in ("tiktok", "youtube", "facebook")])).alias("platform"))
    got = op.parts(length, _wide_cuts(spark, sf), lim, targets)
    return got.select("video_id", "platform", "part", "part_total", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(
    "d13_clip_to_segments",
    "SELECT video_id, CAST(p AS INTEGER) AS part, i, round(greatest(start_s - p * 4.0e0, 0), 6) AS start_s, round(least(end_s - p * 4.0e0, 4.0e0), 6) AS end_s FROM cues_src, range(3) AS r(p) WHERE end_s > p * 4.0e0 AND start_s < (p + 1) * 4.0e0",
)
def d13(spark, sf):
    vids = cat.cues_src(spark, sf).select("video_id").distinct()
    segs = vids.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("seg_start", F.col("part") * F.lit(4.0)).withColumn("seg_end", F.col("seg_start") + 4.0)
    got = op.clipped(cat.cues_src(spark, sf), segs)
    return got.select("video_id", "part", "i", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("d14_intro_trim", "SELECT video_id, CASE WHEN min(start_s) > 2.0e0 THEN min(start_s) ELSE 0 END AS trim FROM cues_src WHERE i >= video_id % 3 GROUP BY 1")
def d14(spark, sf):
    return op.intro(cat.cues_src(spark, sf).where("i >= video_id % 3"))


@query("d15_playing_at", "SELECT p.video_id, p.at, coalesce(c.i, -1) AS hit FROM (SELECT DISTINCT video_id, t * 1.0e0 AS at FROM cues_src, range(12) AS r(t)) p LEFT JOIN cues_src c ON c.video_id = p.video_id AND c.start_s <= p.at AND p.at < c.end_s")
def d15(spark, sf):
    c = cat.cues_src(spark, sf)
    points = c.select("video_id").distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("at", F.col("at").cast("double"))
    return op.playing(points, c.withColumnRenamed("i", "id")).withColumn("hit", F.coalesce("hit", F.lit(-1).cast("long")))


@query("d16_masks_at", "SELECT p.video_id, p.at, m.id AS hit FROM (SELECT DISTINCT video_id, t * 0.5e0 AS at FROM masks, range(10) AS r(t)) p LEFT JOIN masks m ON m.video_id = p.video_id AND p.at BETWEEN m.start_s AND m.end_s")
def d16(spark, sf):
    m = cat.masks(spark, sf)
    points = m.select("video_id").distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("at", F.col("at") * F.lit(0.5))
    return op.playing(points, m, closed=True)


@query("d17_positional_pairs", "SELECT d.video_id, d.i, d.voice_s AS voice_s, s.txt AS txt FROM cues_dst d JOIN cues_src s USING (video_id, i)")
def d17(spark, sf):
    return op.paired(cat.cues_dst(spark, sf).select("video_id", "i", "voice_s"), cat.cues_src(spark, sf).select("video_id", "i", "txt"), "video_id", "i")


@query("d18_chunks", "SELECT id, (row_number() OVER (PARTITION BY video_id ORDER BY started_at, id) - 1) // 25 AS chunk FROM job_runs")
def d18(spark, sf):
    return op.chunked(cat.job_runs(spark, sf), "video_id", [F.col("started_at"), F.col("id")]).select("id", "chunk")
