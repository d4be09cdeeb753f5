"""Queries over scalar functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import audio, formats, layout, models, subtitles, urls
from lumora.operators import states as op
from lumora.operators.library import alive
from lumora.plans.base import query
from lumora.sources import catalog as cat

#: Urls of the known platforms beside the pages' own.
LINKS = (
    "https://www.douyin.com/video/7312345678901234567", "https://v.douyin.com/iRxAbCd/", "https://www.bilibili.com/video/BV1xx411c7mD", "https://www.youtube.com/watch?v=aqz-KE-bpKQ",
    "https://youtu.be/aqz-KE-bpKQ", "https://www.tiktok.com/@user.name/video/7123456789012345678", "https://x.com/someone/status/1234567890123456789", "https://vm.tiktok.com/ZSabcdef/",
    "https://b23.tv/aBcD12", "https://www.douyin.com/jingxuan/vlog?modal_id=7312345678901234567", "https://netflix.com/title/1", "https://notdouyin.com/video/1", "ftp://x.com/a", "https://m.weibo.com/u/1",
    "https://www.douyin.com/user/MS4wLjAB", "https://space.bilibili.com/12345", "https://www.facebook.com/watch/?v=10153231379946729", "https://www.instagram.com/reel/Cabc-1_/",
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


URLS = f"u AS (SELECT page_id AS pos, url FROM pages UNION ALL SELECT 1000000 + i, url FROM (SELECT unnest(range({len(LINKS)})) AS i, unnest([{', '.join(map(_q, LINKS))}]) AS url))"
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
MATCH = [(p, urls.BOUNDARY + r, prov) for p, r, prov in urls.SOURCES]
PLATFORM = " ".join(f"WHEN regexp_matches(url, {_q(r)}) THEN {_q(p)}" for p, r, _ in MATCH) + " " + " ".join(f"WHEN {HOST} = {_q(d)} OR ends_with({HOST}, {_q('.' + d)}) THEN {_q(p)}" for d, p in urls.DOMAINS)
ID = " ".join(f"WHEN regexp_matches(url, {_q(r)}) THEN regexp_extract(url, {_q(r)}, 1)" for _, r, _ in MATCH)
PROVISIONAL = " ".join(f"WHEN regexp_matches(url, {_q(r)}) THEN {str(prov).lower()}" for _, r, prov in MATCH)
PARSED = f"{URLS}, s AS (SELECT pos, url, CASE {PLATFORM} ELSE 'other' END AS platform, CASE {ID} ELSE 'u' || substr(md5(url), 1, 16) END AS source_id, CASE {PROVISIONAL} ELSE true END AS provisional FROM u WHERE regexp_matches(url, '^https?://'))"


def links(spark, sf):
    more = spark.createDataFrame([(1000000 + i, u) for i, u in enumerate(LINKS)], "pos long, url string")
    return cat.table(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url").unionByName(more)


def parsed(spark, sf):
    s = links(spark, sf).select("pos", urls.source(F.col("url")).alias("s")).where("s IS NOT NULL")
    return s.select("pos", F.col("s.platform").alias("platform"), F.col("s.id").alias("source_id"), F.col("s.provisional").alias("provisional"), F.col("s.url").alias("url"))


@query("h01_source_url", "SELECT pos, platform, source_id, provisional FROM s", PARSED)
def h01(spark, sf):
    return parsed(spark, sf).drop("url")


@query("h02_domain_fallback", f"SELECT pos, {HOST} AS host, platform FROM s WHERE source_id = 'u' || substr(md5(url), 1, 16)", PARSED)
def h02(spark, sf):
    rows = parsed(spark, sf).where(F.col("source_id") == F.concat(F.lit("u"), F.substring(F.md5("url"), 1, 16)))
    return rows.select("pos", urls.host_of(F.col("url")).alias("host"), "platform")


@query("h03_canonical_url", "SELECT pos, CASE WHEN platform = 'douyin' AND NOT provisional AND regexp_matches(source_id, '^[0-9]+$') THEN 'https://www.douyin.com/video/' || source_id ELSE url END AS url FROM s", PARSED)
def h03(spark, sf):
    return parsed(spark, sf).select("pos", "url")


CHANNEL = [" ".join(f"WHEN regexp_matches(url, {_q(r)}) THEN {f(p, r)}" for p, r in urls.CHANNELS) for f in (lambda p, r: _q(p), lambda p, r: f"regexp_extract(url, {_q(r)}, 1)")]


@query("h04_channel_url", f"SELECT pos, CASE {CHANNEL[0]} END AS platform, CASE {CHANNEL[1]} END AS channel FROM u WHERE regexp_matches(url, '^https?://')", URLS)
def h04(spark, sf):
    rows = links(spark, sf).where(F.col("url").rlike("^https?://")).withColumn("c", urls.channel(F.col("url")))
    return rows.select("pos", F.col("c.platform").alias("platform"), F.col("c.id").alias("channel"))


MODELS = ("gemini-3.5-flash-lite", "models/gemini-2.5-flash-tts", "openai/gpt-audio", "google/gemini-3-pro-image", "x-ai/grok-4", "aion-labs/aion-2.0", "o3-mini", "text-embedding-004", "veo-3", "claude-x", "qwen/qwen3-235b", "gpt-4o-mini-tts", "unknown-model", "meta-llama/llama-4")
NAMES = f"n AS (SELECT p_partkey AS id, list_extract([{', '.join(map(_q, MODELS))}], CAST(p_partkey % {len(MODELS)} AS INTEGER) + 1) AS name, CASE p_partkey % 4 WHEN 1 THEN ['text'] WHEN 2 THEN ['text', 'audio'] WHEN 3 THEN ['image'] END AS outs FROM part), m AS (SELECT *, regexp_replace(lower(regexp_replace(trim(name), '^models/', '')), '^[^/]*/', '') AS bare FROM n)"
TTS, BAD, FAM, AUD = (_q(x) for x in (models.TTS, models.UNUSABLE, models.FAMILIES, models.AUDIO))


def _models(spark, sf):
    k = F.col("p_partkey")
    outs = F.when(k % 4 == 1, F.array(F.lit("text"))).when(k % 4 == 2, F.array(F.lit("text"), F.lit("audio"))).when(k % 4 == 3, F.array(F.lit("image")))
    return cat.table(spark, sf, "part").select(k.alias("id"), cat.choice(k, MODELS).alias("name"), outs.alias("outs"))


@query(
    "h05_model_purpose",
    f"SELECT id, bare, CASE WHEN regexp_matches(bare, {TTS}) THEN 'tts' WHEN regexp_matches(bare, {BAD}) THEN 'other' WHEN len(outs) = 2 THEN 'tts' WHEN outs[1] = 'image' THEN 'other' WHEN outs[1] = 'text' THEN 'translate' WHEN regexp_matches(bare, {FAM}) THEN 'translate' ELSE 'other' END AS purpose FROM m",
    NAMES,
)
def h05(spark, sf):
    return _models(spark, sf).select("id", models.bare(F.col("name")).alias("bare"), models.purpose(F.col("name"), F.col("outs")).alias("purpose"))


@query("h06_cannot_translate", f"SELECT id, regexp_matches(bare, {TTS}) OR regexp_matches(bare, {BAD}) OR regexp_matches(bare, {AUD}) AS blocked FROM m", NAMES)
def h06(spark, sf):
    return _models(spark, sf).select("id", models.cannot_translate(F.col("name")).alias("blocked"))


@query(
    "h07_models_for_purpose",
    f"SELECT id % 40 AS k, string_agg(name, ',' ORDER BY id) FILTER (WHERE regexp_matches(bare, {TTS})) AS tts FROM m GROUP BY 1",
    NAMES,
)
def h07(spark, sf):
    rows = _models(spark, sf).groupBy((F.col("id") % 40).alias("k")).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("a"))
    return rows.select("k", F.nullif(F.array_join(models.usable_for(F.transform("a", lambda x: x["name"]), "tts"), ","), F.lit("")).alias("tts"))


@query("h08_model_payload", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'a,m' || event_id WHEN 1 THEN 'm' || event_id || ',z' WHEN 2 THEN 'p,q' ELSE '' END AS names FROM events")
def h08(spark, sf):
    k, m = F.col("event_id") % 4, F.concat(F.lit("m"), F.col("event_id").cast("string"))
    j = (
        F.when(k == 0, F.concat(F.lit('{"data":[{"id":"models/'), m, F.lit('"},{"id":"a"},{"id":"a"}]}')))
        .when(k == 1, F.concat(F.lit('{"models":[{"name":"z"},{"name":"'), m, F.lit('"}]}')))
        .when(k == 2, F.lit('["q","p"]'))
        .otherwise(F.lit('"nothing"'))
    )
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array_join(models.listed(j), ",").alias("names"))


@query("h09_json_array", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'x|' || event_id WHEN 1 THEN 'y' END AS items FROM events")
def h09(spark, sf):
    k = F.col("event_id") % 3
    t = F.when(k == 0, F.concat(F.lit('Here:\n```json\n["x","'), F.col("event_id").cast("string"), F.lit('"]\n``` done'))).when(k == 1, 'text ["y"] more').otherwise("no array")
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array_join(models.json_array(t), "|").alias("items"))


@query(
    "h10_timestamps",
    """SELECT event_id AS id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass
    FROM (SELECT event_id, CAST(round_even(value * 37 * 1000, 0) AS BIGINT) AS ms, CAST(round_even(value * 37 * 100, 0) AS BIGINT) AS cs FROM events)""",
)
def h10(spark, sf):
    s = F.col("value") * 37
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), subtitles.srt_stamp(s).alias("srt"), subtitles.ass_stamp(s).alias("ass"))


@query("h11_ass_escape", "SELECT event_id AS id, replace(replace(replace(props, '{', '('), '}', ')') || chr(10) || 'x', chr(10), '\\N') AS txt FROM events")
def h11(spark, sf):
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), subtitles.ass_escaped(F.concat("props", F.lit("\nx"))).alias("txt"))


@query(
    "h12_filter_escape",
    "SELECT event_id AS id, replace(replace(replace(replace(replace(replace(replace(props || '[it''s; a\\b]', '\\', '\\\\\\\\'), ':', '\\\\:'), '''', '\\\\\\'''), ',', '\\,'), ';', '\\;'), '[', '\\['), ']', '\\]') AS txt FROM events",
)
def h12(spark, sf):
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), formats.filter_escaped(F.concat("props", F.lit("[it's; a\\b]"))).alias("txt"))


WIDTH = "".join(f" + {share}e0 * (length(t) - length(translate(t, {_q(chars)}, '')))" for share, chars in layout.WIDTHS.items())
KNOWN = _q("".join(layout.WIDTHS.values()))


@query("h13_text_width", f"SELECT event_id AS id, round((0e0{WIDTH} + length(translate(t, {KNOWN}, ''))) * 40, 6) AS width FROM (SELECT event_id, props || '字é' AS t FROM events)")
def h13(spark, sf):
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(layout.text_width(F.concat("props", F.lit("字é")), F.lit(40)), 6).alias("width"))


@query("h14_fit_text")
def h14(spark, sf):
    c = cat.cues_src(spark, sf).withColumn("f", layout.fit_text("txt", F.lit(800), F.lit(180)))
    return c.select("video_id", "i", F.col("f.text").alias("txt"), F.col("f.size").alias("size"))


@query("h15_style_scale", "SELECT p_partkey AS id, greatest(1, CAST(round_even(72e0 * (480 + p_size * 20) / 1920, 0) AS INTEGER)) AS font, greatest(1, CAST(round_even(2e0 * (480 + p_size * 20) / 1920, 0) AS INTEGER)) AS outline FROM part")
def h15(spark, sf):
    height = 480 + F.col("p_size") * 20
    return cat.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), layout.scaled(72.0, height).alias("font"), layout.scaled(2.0, height).alias("outline"))


@query("h16_progress_line", "SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN least(100, greatest(0, CAST(trunc(event_id * 1000 / 1e6 / value * 100) AS INTEGER))) END AS percent FROM events WHERE value > 0")
def h16(spark, sf):
    e = F.col("event_id")
    line = F.when(e % 3 == 0, "frame=12").otherwise(F.concat(F.lit("out_time_ms="), (e * 1000).cast("string")))
    return cat.table(spark, sf, "events").where("value > 0").select(e.alias("id"), formats.progress(line, F.col("value")).alias("percent"))


@query(
    "h17_formats",
    """SELECT event_id AS id, CASE WHEN value > 0 THEN printf('%d:%02d', CAST(floor(value / 60) AS BIGINT), CAST(floor(value - 60 * floor(value / 60) + 0.5e0) AS BIGINT)) ELSE '—' END AS length,
      CASE WHEN event_id < 60 THEN 'vừa xong' WHEN event_id < 3600 THEN event_id // 60 || ' phút trước' WHEN event_id < 86400 THEN event_id // 3600 || ' giờ trước' ELSE event_id // 86400 || ' ngày trước' END AS age,
      CASE WHEN (event_id * 500 + 3) >= 1000000 THEN replace(regexp_replace(printf('%.1f', (event_id * 500 + 3) / 1e6), '\\.0$', ''), '.', ',') || 'M' WHEN (event_id * 500 + 3) >= 1000 THEN replace(regexp_replace(printf('%.1f', (event_id * 500 + 3) / 1e3), '\\.0$', ''), '.', ',') || 'K' ELSE CAST((event_id * 500 + 3) AS VARCHAR) END AS tokens
    FROM events""",
)
def h17(spark, sf):
    e = F.col("event_id")
    return cat.table(spark, sf, "events").select(e.alias("id"), formats.duration(F.col("value")).alias("length"), formats.age(e).alias("age"), formats.tokens(e * 500 + 3).alias("tokens"))


@query(
    "h18_sample_warnings",
    "SELECT event_id AS id, array_to_string(list_filter([CASE WHEN value < 7 THEN 'too_short' WHEN value > 15 THEN 'too_long' END, CASE WHEN event_id % 100 >= 99 THEN 'clipped' END, CASE WHEN event_id % 50 / 1000e0 < 0.02e0 THEN 'too_quiet' END, CASE WHEN event_id % 10 / 10e0 > 0.4e0 THEN 'too_silent' END], lambda x: x IS NOT NULL), ',') AS warnings FROM events",
)
def h18(spark, sf):
    e = F.col("event_id")
    w = audio.warnings(F.col("value"), e % 50 / F.lit(1000.0), e % 100 / F.lit(100.0), e % 10 / F.lit(10.0))
    return cat.table(spark, sf, "events").select(e.alias("id"), F.array_join(w, ",").alias("warnings"))


@query("h19_token_cap", "SELECT video_id, i, CAST(trunc(least(600e0, greatest(150e0, greatest(1e0, length(txt) / 15e0) * 23 * 2e0))) AS INTEGER) AS cap, length(txt || repeat('x', CAST(i * 15 AS INTEGER))) > length(txt) * 2 AND txt || repeat('x', CAST(i * 15 AS INTEGER)) <> '' AS answered FROM cues_src")
def h19(spark, sf):
    read = F.concat("txt", F.repeat(F.lit("x"), (F.col("i") * 15).cast("int")))
    return cat.cues_src(spark, sf).select("video_id", "i", formats.token_cap(F.col("txt")).alias("cap"), formats.answered(F.col("txt"), read).alias("answered"))


@query(
    "h20_limit_violations",
    "SELECT video_id, part, platform, array_to_string(list_filter([CASE WHEN title_len - k * 60 <= 0 THEN 'title_len' END, CASE WHEN max_sec - k < 0 THEN 'max_sec' END, CASE WHEN sa_top + k * 0.15e0 >= 0.5e0 THEN 'sa_top' END, CASE WHEN sa_top + k * 0.15e0 + sa_bottom > 0.6e0 THEN 'vertical' END], lambda x: x IS NOT NULL), ',') AS wrong FROM (SELECT *, CAST(part % 4 AS INTEGER) AS k FROM variants) JOIN limits USING (platform)",
)
def h20(spark, sf):
    """The limits of each variant's platform, changed by its part, and what is wrong with them."""
    rows = cat.variants(spark, sf).withColumn("k", (F.col("part") % 4).cast("int")).join(F.broadcast(cat.limits(spark)), "platform")  # 5 fixed rows
    rows = rows.withColumns({"title_len": F.col("title_len") - F.col("k") * 60, "max_sec": F.col("max_sec") - F.col("k"), "sa_top": F.col("sa_top") + F.col("k") * F.lit(0.15)})
    return rows.select("video_id", "part", "platform", F.array_join(op.limit_violations(), ",").alias("wrong"))


@query("h21_config_overlay", "SELECT event_id AS id, event_type AS tone, 'b' || event_id % 3 AS mode, '1' AS kept FROM events")
def h21(spark, sf):
    m = op.overlaid(
        op.overlaid(F.create_map(F.lit("tone"), F.lit("old"), F.lit("kept"), F.lit("1"), F.lit("gone"), F.lit("x")), F.create_map(F.lit("tone"), F.col("event_type"))),
        F.create_map(F.lit("mode"), F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string"))),
    )
    m = op.without(m, "gone")
    rows = cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), m.alias("m"))
    return rows.where(F.size("m") == 3).select("id", F.col("m.tone").alias("tone"), F.col("m.mode").alias("mode"), F.col("m.kept").alias("kept"))


@query("h22_config_precedence", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'own' WHEN event_id % 5 = 0 THEN 'global' ELSE 'blur' END AS mode, CASE event_id % 4 WHEN 0 THEN 'youtube,zalo' WHEN 1 THEN 'facebook' ELSE 'tiktok' END AS platforms FROM events")
def h22(spark, sf):
    e = F.col("event_id")
    config = F.when(e % 4 == 0, '{"target_platforms":["youtube","zalo"]}').when(e % 4 == 1, '{"target_platforms":"facebook"}').when(e % 4 == 2, '{"target_platforms":[]}').otherwise("{}")
    mode = op.first_filled(F.when(e % 3 == 0, "own").otherwise(""), F.when(e % 5 == 0, "global"), F.lit("blur"))
    return cat.table(spark, sf, "events").select(e.alias("id"), mode.alias("mode"), F.array_join(op.target_platforms(config), ",").alias("platforms"))


@query("h23_known_names", "SELECT event_id AS id, 'tiktok,' || event_type AS names, event_type AS unknown FROM events")
def h23(spark, sf):
    n = op.known_names(F.array(F.lit(" TikTok"), F.col("event_type"), F.lit("tiktok ")), ("tiktok", "youtube", "facebook", "instagram", "zalo"))
    rows = cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), n.alias("n"))
    return rows.select("id", F.array_join("n.names", ",").alias("names"), F.array_join("n.unknown", ",").alias("unknown"))


@query("h24_patch_cues", "SELECT video_id, i, CASE WHEN i % 2 = 0 THEN 'edit ' || i ELSE txt END AS txt, start_s, i % 2 = 0 AS edited FROM cues_dst")
def h24(spark, sf):
    rows = cat.cues_dst(spark, sf).select("video_id", "i", "start_s", "txt")
    edits = rows.where("i % 2 = 0").select("video_id", "i", F.concat(F.lit("edit "), F.col("i").cast("string")).alias("new_txt"))
    return op.patched(rows, edits).select("video_id", "i", "txt", "start_s", "edited")


@query("h25_retranslate_merge", "SELECT d.video_id, d.i, CASE WHEN d.i % 3 = 0 THEN d.txt ELSE coalesce(s.txt, d.txt) END AS txt, d.start_s FROM cues_dst d LEFT JOIN cues_src s ON s.video_id = d.video_id AND s.i = d.i AND s.i % 2 = 0")
def h25(spark, sf):
    old = cat.cues_dst(spark, sf).select("video_id", "i", "start_s", "txt", (F.col("i") % 3 == 0).alias("edited"))
    new = cat.cues_src(spark, sf).where("i % 2 = 0").select("video_id", "i", F.col("txt").alias("new_txt"))
    return op.retranslated(old, new).select("video_id", "i", "txt", "start_s")


@query(
    "h26_ingest_links",
    """SELECT l.pos AS pos, s.platform AS platform, s.source_id AS source_id, CASE WHEN s.source_id IS NULL THEN 'invalid' WHEN NOT x.deleted OR r > 1 THEN 'duplicate' WHEN x.deleted THEN 'revived' ELSE 'created' END AS outcome
    FROM u l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY platform, source_id ORDER BY pos) AS r FROM s) s ON s.pos = l.pos LEFT JOIN x USING (platform, source_id)""",
    PARSED + ", x AS (SELECT platform, source_id, min(pos) % 2 = 0 AS deleted FROM s WHERE pos % 5 = 0 GROUP BY 1, 2)",
)
def h26(spark, sf):
    have = parsed(spark, sf).where("pos % 5 = 0").groupBy("platform", "source_id").agg((F.min("pos") % 2 == 0).alias("deleted"))
    return op.ingested(links(spark, sf), have)


@query(
    "h27_status_guards",
    "SELECT id, CASE WHEN status = 'review' THEN 'ready' ELSE status END AS approved, CASE WHEN status IN ('skipped', 'error') THEN 'queued' ELSE status END AS retried, CASE WHEN status = 'error' THEN NULL WHEN status IN ('ready', 'posted') THEN 'done' WHEN status <> 'review' THEN 'busy' END AS refused FROM videos WHERE NOT deleted",
)
def h27(spark, sf):
    rows = alive(cat.videos(spark, sf))
    return rows.select("id", op.after("approve").alias("approved"), op.after("retry").alias("retried"), op.translate_refused().alias("refused"))


@query(
    "h28_retry_plan",
    """SELECT id, CASE WHEN step IN ('detect', 'inpaint', 'render') THEN array_to_string(['detect', 'inpaint', 'render'][list_position(['detect', 'inpaint', 'render'], step):], ',')
      WHEN step IN ('translate', 'format_sub', 'tts') THEN array_to_string(['translate', 'format_sub', 'tts'][list_position(['translate', 'format_sub', 'tts'], step):], ',')
      WHEN step IN ('download', 'probe', 'transcribe') THEN array_to_string(['download', 'probe', 'transcribe'][list_position(['download', 'probe', 'transcribe'], step):], ',') ELSE 'download,probe,transcribe' END AS steps
    FROM (SELECT id, list_extract(['download', 'probe', 'transcribe', 'translate', 'format_sub', 'detect', 'inpaint', 'shortform', 'tts', 'render', 'qc', 'upload'], step + 1) AS step FROM job_runs)""",
)
def h28(spark, sf):
    step = cat.choice(F.col("step"), cat.STEPS)
    return cat.job_runs(spark, sf).select("id", F.array_join(op.retry_steps(step, F.lit(False)), ",").alias("steps"))


@query("h30_voice_params", "SELECT id, state AS tts_provider, CASE WHEN id % 2 = 0 THEN 'm' END AS tts_model, CASE WHEN id % 2 = 0 THEN 4 ELSE 3 END AS n FROM voices")
def h30(spark, sf):
    m = op.voice_params(F.col("state"), F.col("name"), F.when(F.col("id") % 2 == 0, "m").otherwise(""), F.col("id"))
    return cat.voices(spark, sf).select("id", m.alias("p")).select("id", F.col("p.tts_provider").alias("tts_provider"), F.col("p.tts_model").alias("tts_model"), F.size("p").alias("n"))


@query("b03_media_paths", "SELECT l_orderkey AS id, l_linenumber AS part, 'media/raw/' || l_returnflag || '/' || l_partkey || '/source.mp4' AS raw, 'media/work/' || l_orderkey || '/sub.vi.srt' AS work FROM lineitem")
def b03(spark, sf):
    return cat.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), formats.raw_path("media", F.col("l_returnflag"), F.col("l_partkey").cast("string")).alias("raw"),
        formats.work_path("media", F.col("l_orderkey"), "sub.vi.srt").alias("work"),
    )


@query("b05_frame_times", "SELECT id, list_transform(range(0, 5), lambda i: CAST(round_even(duration_sec * (i + 0.5e0) / 5, 3) AS DOUBLE)) AS times FROM videos")
def b05(spark, sf):
    return cat.videos(spark, sf).select("id", formats.frame_times(F.col("duration_sec"), 5).alias("times"))


@query("b06_media_info", "SELECT event_id AS id, value AS duration_sec, CAST(720 + event_id % 3 AS INTEGER) AS width, CASE event_id % 2 WHEN 0 THEN 25e0 ELSE 0e0 END AS fps, event_id % 3 = 0 AS has_audio FROM events")
def b06(spark, sf):
    e = F.col("event_id")
    report = F.concat(
        F.lit('{"streams":['), F.when(e % 3 == 0, '{"codec_type":"audio"},').otherwise(""), F.lit('{"codec_type":"video","width":'), (720 + e % 3).cast("string"),
        F.lit(',"height":1280,"avg_frame_rate":"'), F.when(e % 2 == 0, "50/2").otherwise("1/0"), F.lit('"}],"format":{"duration":"'), F.col("value").cast("string"), F.lit('","size":"9"}}'),
    )
    rows = cat.table(spark, sf, "events").select(e.alias("id"), formats.media_info(report).alias("m"))
    return rows.select("id", "m.duration_sec", "m.width", "m.fps", "m.has_audio")
