"""Queries over progress messages, as batches of what the streams see."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumora.functions import subtitles as sub
from lumora.operators.order import shared_folder
from lumora.plans.base import query
from lumora.plans.intervals import cue_arrays
from lumora.sources import catalog as cat
from lumora.sources import files
from lumora.streaming import progress as op
from lumora.streaming import sinks, states

TOPIC = "t AS (SELECT channel, payload, ingest_ts, 'video:' || regexp_extract(channel, '^media:(?:progress|status):(.+)$', 1) AS topic, json_extract_string(payload, '$.status') AS status FROM stream_events)"


def messages(spark, sf):
    rows = cat.stream_events(spark, sf)
    return rows.withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp"))


def event_stream(spark, sf):
    """The events table as a stream of its files."""
    return spark.readStream.schema(cat.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(sf)


def fresh(spark):
    return f"{shared_folder(spark, 'lumora-streams')}/{uuid.uuid4().hex}"


PUBLISHED = "p AS (SELECT event_id AS id, 'media:progress:' || user_id AS channel, '{\"video_id\":\"' || user_id || '\",\"step\":\"render\",\"percent\":' || least(100, greatest(0, event_id % 150 - 20)) || '}' AS payload FROM events)"


@query("j01_publish_progress", "SELECT id, channel, payload FROM p", PUBLISHED)
def j01(spark, sf):
    """Progress messages made from a stream of events and published through the sink, once each."""
    channel, payload = op.published(F.col("user_id").cast("string"), (F.col("event_id") % 150 - 20).cast("int"), F.lit("render"))
    rows = event_stream(spark, sf).select(F.col("event_id").alias("id"), channel.alias("channel"), payload.alias("payload"))
    return sinks.deliver(rows, fresh(spark)).good.drop("batch")


@query("j02_subscribe_stream", "SELECT event_id, channel FROM (SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'media:status:' ELSE 'media:progress:' END || user_id AS channel FROM events) WHERE regexp_matches(channel, '^media:status:[0-9]*[02468]$')")
def j02(spark, sf):
    """The status messages of even videos, by a channel pattern on a stream that is supervised to its end."""
    rows = event_stream(spark, sf)
    named = rows.select("event_id", *[c.alias(n) for n, c in zip(("channel", "payload"), cat.message_of())])
    kept = sinks.subscribed(named, "media:status:*[02468]").select("event_id", "channel")
    at = fresh(spark)
    sinks.supervised(lambda: kept.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start())
    return spark.read.schema(kept.schema).parquet(f"{at}/rows")


@query("j03_topics", "SELECT channel, topic, count(*) AS n FROM t GROUP BY 1, 2", TOPIC)
def j03(spark, sf):
    return messages(spark, sf).groupBy("channel", op.topic_of(F.col("channel")).alias("topic")).agg(F.count("*").alias("n"))


@query("j04_delivered", "SELECT client, topic, count(*) AS n FROM t JOIN (SELECT c_custkey % 5 AS client, 'video:' || c_custkey AS topic FROM customer WHERE c_custkey % 3 = 0) USING (topic) GROUP BY 1, 2", TOPIC)
def j04(spark, sf):
    k = F.col("c_custkey")
    subs = cat.table(spark, sf, "customer").where(k % 3 == 0).select((k % 5).alias("client"), F.concat(F.lit("video:"), k.cast("string")).alias("topic"))
    return op.delivered(messages(spark, sf), subs).groupBy("client", "topic").agg(F.count("*").alias("n"))


@query("j05_bad_messages", "SELECT CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'channel' ELSE 'good' END AS kind, count(*) AS n FROM events GROUP BY 1")
def j05(spark, sf):
    """Good messages and dead letters, as the two sinks of one stream hold them."""
    e = F.col("event_id") % 5
    rows = event_stream(spark, sf).select(F.when(e == 1, "other:x").otherwise("media:status:7").alias("channel"), F.when(e == 0, "{broken").otherwise('{"status":"ready"}').alias("payload"), "event_id")
    sent = sinks.deliver(rows, fresh(spark))
    kinds = sent.good.select(F.lit("good").alias("kind")).unionByName(sent.dead.select(F.col("fault").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "j06_status_recount",
    "SELECT status, count(*) AS n FROM (SELECT topic, arg_max(status, (ingest_ts, status)) AS status FROM t WHERE channel LIKE 'media:status:%' GROUP BY 1) GROUP BY 1",
    TOPIC,
)
def j06(spark, sf):
    """Counts kept by a stream of status changes."""
    return sinks.recounted(cat.as_stream_events(event_stream(spark, sf)), fresh(spark))


@query(
    "j07_step_lifecycle",
    """SELECT video_id, step, CASE WHEN late OR nxt = 'start' THEN 'failed' ELSE nxt END AS status, round(CASE WHEN late THEN 432000 ELSE epoch_us(nat) / 1e6 - epoch_us(tm) / 1e6 END, 3) AS duration_sec,
      CASE WHEN late THEN 'no end in time' WHEN nxt = 'start' THEN 'started again' ELSE nlog END AS log FROM r WHERE kind = 'start' AND CASE WHEN late THEN epoch_us(tm) + 432000000000 <= (SELECT max(epoch_us(tm)) FROM r) ELSE nxt IS NOT NULL END""",
    """e AS (SELECT user_id AS video_id, CAST(event_id % 2 AS INTEGER) AS step, date_trunc('milliseconds', ts) AS tm, CASE WHEN event_type IN ('click', 'signup') THEN 'start' WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS kind, props AS log FROM events),
    r AS (SELECT *, nat IS NULL OR epoch_us(nat) - epoch_us(tm) > 432000000000 AS late FROM (SELECT *, lead(kind) OVER w AS nxt, lead(tm) OVER w AS nat, lead(log) OVER w AS nlog FROM e WINDOW w AS (PARTITION BY video_id, step ORDER BY tm, kind)))""",
)
def j07(spark, sf):
    """Runs of a stream of step events, closed by their end, by another start, or after five days."""
    kind = F.when(F.col("event_type").isin("click", "signup"), "start").when(F.col("event_type") == "error", "failed").otherwise("success")
    events = event_stream(spark, sf).select(F.col("user_id").alias("video_id"), (F.col("event_id") % 2).cast("int").alias("step"), kind.alias("kind"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("at"), F.col("props").alias("log"))
    rows = op.drained(states.lifecycle(events, seconds=432000))
    return rows.select("video_id", "step", "status", F.round("duration_sec", 3).alias("duration_sec"), "log")


@query(
    "j08_single_run",
    "SELECT channel, ts AS ingest_ts FROM runs",
    """runs AS (SELECT channel, min(ingest_ts) AS ts FROM stream_events GROUP BY 1
      UNION ALL SELECT r.channel, min(e.ingest_ts) FROM runs r JOIN stream_events e ON e.channel = r.channel AND e.ingest_ts >= r.ts + INTERVAL 7200 SECOND GROUP BY r.channel, r.ts)""",
)
def j08(spark, sf):
    """The messages that find their channel's lock free; each holds it for two hours."""
    return op.deduplicated(cat.stream_events(spark, sf), ["channel"]).select("channel", "ingest_ts")


@query("b04_file_md5")
def b04(spark, sf):
    """MD5 of all files under a folder, whole files through Spark's reader. The oracle's SQL has no path to read them by."""
    return op.file_md5(spark, sf).select("name", "md5", "size")


STAMPED = """st AS (SELECT video_id, i, txt, row_number() OVER (PARTITION BY video_id ORDER BY start_s, i) AS k, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS a, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS b,
      CAST(round_even(start_s * 100, 0) AS BIGINT) AS ca, CAST(round_even(end_s * 100, 0) AS BIGINT) AS cb FROM cues_src)"""


def srt_sql(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def ass_sql(cs: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


@query("b08_srt_document", f"SELECT video_id, string_agg(k || chr(10) || {srt_sql('a')} || ' --> ' || {srt_sql('b')} || chr(10) || txt || chr(10), chr(10) ORDER BY k) AS doc FROM st GROUP BY 1", STAMPED)
def b08(spark, sf):
    return cue_arrays(cat.cues_src(spark, sf)).select("video_id", sub.srt_document(F.col("cues")).alias("doc"))


@query("b08b_srt_files", f"SELECT CAST(video_id AS VARCHAR) AS name, string_agg(k || chr(10) || {srt_sql('a')} || ' --> ' || {srt_sql('b')} || chr(10) || txt || chr(10), chr(10) ORDER BY k) AS content FROM st GROUP BY 1", STAMPED)
def b08b(spark, sf):
    """Each video's subtitles written as an SRT file, and the files read back."""
    at = fresh(spark).removeprefix("file:")
    files.write_files(b08(spark, sf).select(F.col("video_id").alias("name"), F.col("doc").alias("content")), at, ".srt")
    return files.read_files(spark, at, ".srt")


ASS_HEAD = (
    "[Script Info]\nScriptType: v4.00+\nPlayResX: 720\nPlayResY: 1280\nWrapStyle: 0\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, "
    "BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,Be Vietnam Pro,69,&H00FFFFFF,&H00FFFFFF,&H00000000,&H00000000,-1,0,0,0,100,100,0,0,1,2,1,2,36,36,230,1\n\n"
    "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)


@query(
    "b09_ass_document",
    f"SELECT video_id, '{ASS_HEAD}' || string_agg('Dialogue: 0,' || {ass_sql('ca')} || ',' || {ass_sql('cb')} || ',Default,,0,0,0,,' || replace(replace(replace(txt, '{{', '('), '}}', ')'), chr(10), '\\N') || chr(10), '' ORDER BY k) AS doc FROM st GROUP BY 1",
    STAMPED,
)
def b09(spark, sf):
    """Each video's subtitles as an ASS document for 720 by 1280 within the first platform's margins."""
    return cue_arrays(cat.cues_src(spark, sf)).select("video_id", sub.ass_document(F.col("cues"), 720, 1280, F.lit(0.05), F.lit(0.18)).alias("doc"))


@query(
    "b09b_ass_files",
    f"SELECT CAST(video_id AS VARCHAR) AS name, '{ASS_HEAD}' || string_agg('Dialogue: 0,' || {ass_sql('ca')} || ',' || {ass_sql('cb')} || ',Default,,0,0,0,,' || replace(replace(replace(txt, '{{', '('), '}}', ')'), chr(10), '\\N') || chr(10), '' ORDER BY k) AS content FROM st GROUP BY 1",
    STAMPED,
)
def b09b(spark, sf):
    """The ASS documents written as files twice, which leaves those of the first time alone, and read back."""
    at, rows = fresh(spark).removeprefix("file:"), b09(spark, sf).select(F.col("video_id").alias("name"), F.col("doc").alias("content"))
    files.write_files(rows, at, ".ass")
    files.write_files(rows, at, ".ass", mode="append")  # this mode refuses to change a file
    return files.read_files(spark, at, ".ass")
