"""Text for people and for filters: sizes, counts, ages, escapes, progress lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and tokens a second of speech, slack, bounds; how much longer an answer may be.
CHARS_S, TOKENS_S, SLACK, LEAST_TOKENS, MOST_TOKENS, LONGER = 15, 23, 2.0, 150, 600, 2.0


def duration(seconds: Column) -> Column:
    """m:ss; a dash for null, 0 and less."""
    shown = F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), F.floor(seconds % 60 + 0.5).cast("long"))
    return F.when(seconds > 0, shown).otherwise("—")


def age(seconds: Column) -> Column:
    """How long ago, by the largest whole unit."""
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(name))
    return F.when(seconds < 60, "vừa xong").when(seconds < 3600, unit(60, " phút trước")).when(seconds < 86400, unit(3600, " giờ trước")).otherwise(unit(86400, " ngày trước"))


def tokens(n: Column) -> Column:
    """Thousands as K, millions as M, with one decimal behind a comma unless it is 0."""
    short = lambda x, s: F.concat(F.replace(F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit("."), F.lit(",")), F.lit(s))
    return F.when(n >= 1e6, short(n / 1e6, "M")).when(n >= 1e3, short(n / 1e3, "K")).otherwise(n.cast("long").cast("string"))


def megabytes(size: Column) -> Column:
    mb = size / (1024 * 1024)
    return F.when(size.isNull() | (size < 0), "—").when(mb < 10, F.format_string("%.2f MB", mb)).otherwise(F.format_string("%.1f MB", mb))


def filter_escaped(text: Column) -> Column:
    """Text inside a filter description: backslashes first, then colons, quotes, and what separates filters."""
    out = F.replace(text, F.lit("\\"), F.lit("\\" * 4))
    out = F.replace(F.replace(out, F.lit(":"), F.lit("\\\\:")), F.lit("'"), F.lit("\\\\\\'"))
    for c in ",;[]":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def progress(line: Column, seconds: Column) -> Column:
    """Percent 0 to 100 of an encoder's ``out_time_ms=`` line (microseconds, despite its name); null for other lines, 0
    for no duration."""
    us = F.regexp_extract(F.trim(line), r"^out_time_ms=\s*([+-]?[0-9]+)\s*$", 1).try_cast("long")
    share = (us / F.lit(1e6) / F.when(seconds > 0, seconds) * 100).cast("int")
    return F.when(us.isNotNull(), F.when(seconds <= 0, F.lit(0)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), share))))


def token_cap(sentence: Column) -> Column:
    """Highest number of audio tokens of a sentence."""
    s = F.greatest(F.lit(1.0), F.length(sentence) / CHARS_S)
    return F.least(F.lit(float(MOST_TOKENS)), F.greatest(F.lit(float(LEAST_TOKENS)), s * TOKENS_S * SLACK)).cast("int")


def answered(sentence: Column, read: Column) -> Column:
    """Whether what was read is so long that it is an answer."""
    return (read != "") & (F.length(read) > F.length(sentence) * LONGER)


def fps(rate: Column) -> Column:
    """A rate "n/d" as a number; 0 for anything else."""
    n, d = (F.regexp_extract(rate, r"^\s*([0-9.]+)\s*/\s*([0-9.]+)\s*$", k).try_cast("double") for k in (1, 2))
    return F.coalesce(F.when(d > 0, n / d), F.lit(0.0))


STREAMS = "struct<streams:array<struct<codec_type:string,width:int,height:int,avg_frame_rate:string,codec_name:string>>,format:struct<duration:string,size:string>>"


def media_info(report: Column) -> Column:
    """struct of a probe's JSON: the first video stream's size and rate, whether there is sound, duration and bytes."""
    j = F.from_json(report, STREAMS)
    first = lambda kind: F.get(F.filter(j["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v = first("video")
    return F.struct(
        F.coalesce(j["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration_sec"), F.coalesce(v["width"], F.lit(0)).alias("width"), F.coalesce(v["height"], F.lit(0)).alias("height"),
        fps(v["avg_frame_rate"]).alias("fps"), first("audio").isNotNull().alias("has_audio"), F.coalesce(j["format"]["size"].try_cast("long"), F.lit(0).cast("long")).alias("size_bytes"),
    )


def raw_path(root: str, platform: Column, source_id: Column) -> Column:
    return F.concat_ws("/", F.lit(root), F.lit("raw"), platform, source_id, F.lit("source.mp4"))


def work_path(root: str, video_id: Column, name: Column | str) -> Column:
    return F.concat_ws("/", F.lit(root), F.lit("work"), video_id.cast("string"), F.lit(name) if isinstance(name, str) else name)


def frame_times(seconds: Column, n: int) -> Column:
    """Times of ``n`` frames in the middle of equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(seconds * (i + 0.5) / n, 3))
