"""The catalogue's tables as DataFrames, mapped from the Parquet tables; the same mappings are the oracle's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.hashing import hex64, with_fingerprint
from lumora.session import table

#: States of a video, in order.
STATUSES = ("queued", "running", "review", "ready", "scheduled", "posted", "error", "skipped")
#: Steps of the pipeline, in order.
STEPS = ("download", "probe", "transcribe", "translate", "format_sub", "detect", "inpaint", "shortform", "tts", "render", "qc", "upload")
#: Licenses that let a channel be processed automatically.
AUTO_LICENSES = ("permitted", "licensed", "open", "own")
#: Platform, longest part in seconds (0: any), title, description, hashtags, posts a day, safe margins.
LIMITS = (
    ("tiktok", 0, 150, 2200, 30, 3, 0.06, 0.18, 0.05, 0.20),
    ("youtube", 0, 100, 5000, 15, 5, 0.06, 0.14, 0.05, 0.12),
    ("facebook", 0, 255, 2200, 30, 3, 0.08, 0.20, 0.05, 0.18),
    ("instagram", 0, 125, 2200, 30, 3, 0.08, 0.22, 0.05, 0.20),
    ("zalo", 0, 120, 1500, 20, 3, 0.06, 0.16, 0.05, 0.15),
)
LIMITS_SCHEMA = "platform string, max_sec int, title_len int, desc_len int, hashtags int, daily int, sa_top double, sa_bottom double, sa_left double, sa_right double"


def choice(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def minutes_in(key: Column) -> Column:
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(mins=key.cast("int"))


def cues_src(spark: SparkSession, sf: str) -> DataFrame:
    """Source cues, one per turn: (video_id, i, start_s, end_s, txt)."""
    start = F.col("turn") * F.lit(3.0)
    end = start + F.least(F.lit(3.0), F.greatest(F.lit(0.3), F.length("text") / F.lit(400.0)))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("i"), start.alias("start_s"), end.alias("end_s"), F.col("text").alias("txt")
    )


def cues_dst(spark: SparkSession, sf: str) -> DataFrame:
    """Translated cues on another grid, with the length of their voice."""
    start = F.col("turn") * F.lit(2.5)
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("i"), (start + 0.5).alias("start_s"), (start + 2.5).alias("end_s"),
        F.col("text").alias("txt"), (F.length("text") / F.lit(200.0)).alias("voice_s"),
    )


def phash(spark: SparkSession, sf: str) -> DataFrame:
    """(id, phash): 64 bits of each embedding as 16 hex digits, by the rule of the perceptual hash."""
    rows = table(spark, sf, "embeddings").where(F.size("embedding") == 64)
    return with_fingerprint(rows, "embedding").select(F.col("vec_id").alias("id"), hex64(F.col("bits")).alias("phash"))


def video_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, phash): 256 bits as 64 hex digits. Four frames in a row are a film, and four videos show each film, the last
    0, 6, 12 or 18 digits of their hash blanked."""
    films = phash(spark, sf).groupBy(F.floor(F.col("id") / 4).alias("film")).agg(F.array_sort(F.collect_list(F.struct("id", "phash"))).alias("a")).where(F.size("a") == 4)
    films = films.select("film", F.array_join(F.transform("a", lambda x: x["phash"]), "").alias("h"))
    copies = films.select("film", "h", F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("j"))
    return copies.select((F.col("film") * 4 + F.col("j")).alias("id"), F.concat(F.substr("h", F.lit(1), 64 - 6 * F.col("j")), F.repeat(F.lit("0"), 6 * F.col("j"))).alias("phash"))


def frame_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, phash): 64 bits of frames, each with a twin whose last digit is blanked."""
    twins = phash(spark, sf).select("id", "phash", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return twins.select((F.col("id") * 2 + F.col("j")).alias("id"), F.concat(F.substr("phash", F.lit(1), 16 - F.col("j")), F.repeat(F.lit("0"), F.col("j"))).alias("phash"))


def videos(spark: SparkSession, sf: str, hashes: bool = False) -> DataFrame:
    """The library; ``deleted`` marks soft-deleted rows. With ``hashes`` also the perceptual hash, which reads the embeddings."""
    d = table(spark, sf, "documents")
    if hashes:
        p = video_hashes(spark, sf)
        d = d.join(p, d["doc_id"] == p["id"], "left")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("author"), F.col("text").alias("title"), (F.col("n_chars") / F.lit(10.0)).alias("duration_sec"),
        F.md5("text").alias("md5"), *(["phash"] if hashes else []), choice(F.col("doc_id"), STATUSES).alias("status"), minutes_in(F.col("doc_id")).alias("created_at"),
        (F.col("doc_id") % 17 == 0).alias("deleted"),
    )


def cost_logs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    service = F.when(kind.isin("click", "signup"), "llm_translate").when(kind == "view", "tts").when(kind == "purchase", "gpu_inpaint").otherwise("bandwidth")
    unit = F.when(kind.isin("click", "signup"), "token").when(kind.isin("view", "purchase"), "second").otherwise("byte")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), service.alias("service"), unit.alias("unit"),
        F.floor(F.col("value") * 100).cast("double").alias("quantity"), (F.col("value") / 1000).alias("cost_usd"), F.col("ts").alias("created_at"),
    )


def job_runs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "running").otherwise("success")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), F.col("ts").alias("started_at"), (F.col("event_id") % 12).cast("int").alias("step"),
        status.alias("status"), F.col("value").alias("duration_sec"),
    )


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Text boxes by frame, half a second apart."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("id"), F.col("user_id").alias("video_id"), (F.lit(0.5) * place).alias("time"), (e * 37 % 60 / F.lit(100.0)).alias("x"), (e * 53 % 70 / F.lit(100.0)).alias("y"),
        F.lit(0.2).alias("w"), F.lit(0.05).alias("h"), (e % 100 / F.lit(100.0)).alias("confidence"), F.col("props").alias("txt"),
    )


def masks(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    return b.select(
        "id", "video_id", "x", "y", "w", "h", F.col("time").alias("start_s"), (F.col("time") + 1.0).alias("end_s"), "confidence",
        F.when(F.col("id") % 4 == 0, "manual").otherwise("auto").alias("source"),
    )


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_stream_events(table(spark, sf, "events"))


def message_of() -> tuple[Column, Column]:
    """(channel, payload) of an event as a progress or status message."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    channel = F.concat(F.when(kind.isin("error", "purchase"), "media:status:").otherwise("media:progress:"), user)
    status = F.when(kind == "error", "error").when(kind == "purchase", "ready").otherwise("running")
    return channel, F.concat(F.lit('{"video_id":"'), user, F.lit('","status":"'), status, F.lit('"}'))


def as_stream_events(events: DataFrame) -> DataFrame:
    """(channel, payload, ingest_ts) of progress and status messages; works on streams too."""
    channel, payload = message_of()
    return events.select(channel.alias("channel"), payload.alias("payload"), F.col("ts").alias("ingest_ts"))


def channels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("id"), choice(F.col("s_nationkey"), ("douyin", "bilibili", "kuaishou", "xiaohongshu", "weibo")).alias("platform"), F.col("s_name").alias("display_name"),
        (k % 3 != 0).alias("enabled"), choice(k, ("unknown", *AUTO_LICENSES)).alias("license_status"), minutes_in(k).alias("created_at"),
    )


def presets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"), choice(k, ("filter", "process", "antidup", "subtitle")).alias("kind"), F.concat_ws(" ", "p_name", k.cast("string")).alias("name"), (k % 50 == 0).alias("is_default")
    )


def voices(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), choice(k, ("ready", "pending", "error")).alias("state"), (k == 7).alias("is_default"), minutes_in(k * 7 % 1000).alias("created_at")
    )


def variants(spark: SparkSession, sf: str) -> DataFrame:
    platform = choice(F.col("l_orderkey"), ("tiktok", "youtube", "facebook", "instagram", "zalo"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), platform.alias("platform"), F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("duration_sec"), F.col("l_extendedprice").alias("size_kb")
    )


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LIMITS), LIMITS_SCHEMA)


def as_of(spark: SparkSession, sf: str):
    """The moment that windows end at: the latest event."""
    return table(spark, sf, "events").agg(F.max("ts")).first()[0]
