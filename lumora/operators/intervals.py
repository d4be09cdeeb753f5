"""Interval operators on cues and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(dst: DataFrame, src: DataFrame, key: str = "video_id", span: float = 60.0) -> DataFrame:
    """``dst`` (key, i, start_s, end_s) with ``source``: the texts of the overlapping rows of ``src``, in their order,
    joined by " / "; empty if there is none. Touching edges do not overlap.

    Both sides are filed under the time spans of ``span`` seconds that they reach, so rows are compared within a key
    and span only; a pair counts where its later start lies.
    """
    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / span), F.floor(F.greatest(a, b) / span)))

    d = dst.select(key, "i", "start_s", "end_s").withColumn("_c", cells("start_s", "end_s"))
    s = src.select(F.col(key).alias("_k"), F.col("i").alias("_i"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.col("txt").alias("_t")).withColumn("_d", cells("_s", "_e"))
    home = F.floor(F.greatest("start_s", "_s") / span) == F.col("_c")
    hits = d.join(s, (F.col(key) == F.col("_k")) & (F.col("_c") == F.col("_d")) & (F.col("_s") < F.col("end_s")) & (F.col("_e") > F.col("start_s")) & home)
    texts = hits.groupBy(key, "i", "start_s", "end_s").agg(F.array_sort(F.collect_list(F.struct("_s", "_i", "_t"))).alias("_a"))
    texts = texts.select(F.col(key).alias("_k"), F.col("i").alias("_i"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.array_join(F.transform("_a", lambda x: x["_t"]), " / ").alias("source"), F.size("_a").alias("n_source"))
    same = (dst[key] == texts["_k"]) & dst["i"].eqNullSafe(texts["_i"]) & (dst["start_s"] == texts["_s"]) & (dst["end_s"] == texts["_e"])
    return dst.join(texts, same, "left").drop("_k", "_i", "_s", "_e").withColumns({"source": F.coalesce("source", F.lit("")), "n_source": F.coalesce("n_source", F.lit(0))})


def with_next_start(cues: DataFrame, key: str = "video_id") -> DataFrame:
    return cues.withColumn("next_start", F.lead("start_s").over(Window.partitionBy(key).orderBy("start_s", "i")))


def silence_cuts(cues: DataFrame, key: str = "video_id", gap: float = 0.35) -> DataFrame:
    """(key, cut): the middle of each gap of at least ``gap`` between a cue and the next by start."""
    nxt = with_next_start(cues, key)
    return nxt.where(F.col("next_start") - F.col("end_s") >= gap).select(key, ((F.col("end_s") + F.col("next_start")) / 2).alias("cut"))


def part_bounds(total: Column, most: Column, cuts: Column, least: float = 10.0) -> Column:
    """Ends of the parts of [0, total] none longer than ``most`` (0: one part): each the last cut within reach, else the
    reach itself, which is lowered where the rest would fall below ``least`` and that can be helped. A fold, since
    each part starts where the last ended. Negative arguments raise."""
    most = most.cast("double")
    steps = F.size(cuts) + F.ceil(total / F.greatest(most, F.lit(1e-9))).cast("int") + 1
    bounded = F.when((most == 0) | (total <= most), F.lit(1)).otherwise(steps)

    def step(acc: Column, _: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
        reach = at + most
        short = (F.lit(least) < most) & (total - reach > 0) & (total - reach < least)
        bound = F.when(short, total - least).otherwise(reach)
        cut = F.coalesce(F.array_max(F.filter(cuts, lambda p: (p > at) & (p <= bound) & (p > 0) & (p < total))), bound)
        return F.when((most == 0) | (total - at <= most), acc).otherwise(F.concat(acc, F.array(cut)))

    inner = F.aggregate(F.sequence(F.lit(1), bounded), F.array().cast("array<double>"), step)
    wrong = (total < 0) | (most < 0)
    return F.when(wrong, F.raise_error(F.lit("a length below 0")).cast("array<double>")).otherwise(F.concat(inner, F.array(total.cast("double"))))


def parts(videos: DataFrame, cuts: DataFrame, limits: DataFrame, targets: DataFrame, key: str = "video_id", least: float = 10.0) -> DataFrame:
    """(key, platform, part, part_total, start_s, end_s): the parts of each video (key, duration_sec) for each target
    platform (key, platform). A target without limits raises."""
    c = cuts.groupBy(key).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    want = targets.join(F.broadcast(limits.select("platform", "max_sec")), "platform", "left")  # one row a platform
    known = F.when(F.col("max_sec").isNull(), F.raise_error(F.concat(F.lit("no limit for "), F.col("platform"))).cast("int")).otherwise(F.col("max_sec"))
    rows = videos.join(want.withColumn("max_sec", known), key).join(c, key, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    rows = rows.withColumn("ends", part_bounds(F.col("duration_sec"), F.col("max_sec"), F.col("cuts"), least))
    out = rows.select(key, "platform", F.size("ends").alias("part_total"), "ends", F.posexplode("ends").alias("_p", "end_s"))
    start = F.when(F.col("_p") == 0, F.lit(0.0)).otherwise(F.get("ends", F.col("_p") - 1))
    return out.select(key, "platform", (F.col("_p") + 1).alias("part"), "part_total", start.alias("start_s"), "end_s")


def clipped(cues: DataFrame, segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Cues of each segment (key, part, seg_start, seg_end), shifted to its start and cut at its ends; what only touches
    or has no length left is gone."""
    rows = cues.join(segments, key).where((F.col("end_s") > F.col("seg_start")) & (F.col("start_s") < F.col("seg_end")))
    start = F.greatest(F.col("start_s") - F.col("seg_start"), F.lit(0.0))
    end = F.least(F.col("end_s") - F.col("seg_start"), F.col("seg_end") - F.col("seg_start"))
    return rows.select(key, "part", "i", start.alias("start_s"), end.alias("end_s"), "txt").where("end_s > start_s")


def intro(cues: DataFrame, key: str = "video_id", most: float = 2.0) -> DataFrame:
    """(key, trim): the first start if later than ``most``, else 0."""
    first = cues.groupBy(key).agg(F.min("start_s").alias("_f"))
    return first.select(key, F.when(F.col("_f") > most, F.col("_f")).otherwise(F.lit(0.0)).alias("trim"))


def playing(points: DataFrame, cues: DataFrame, key: str = "video_id", closed: bool = False, span: float = 60.0) -> DataFrame:
    """``points`` (key, at) with the rows of ``cues`` (key, id, start_s, end_s) that hold them: [start, end), or [start, end]
    if ``closed``; a point in none has a null ``hit``. Cues are filed under the spans of time they reach."""
    c = cues.select(F.col(key).alias("_k"), F.col("id").alias("hit"), "start_s", "end_s")
    c = c.withColumn("_c", F.explode(F.sequence(F.floor(F.col("start_s") / span), F.floor(F.greatest("start_s", "end_s") / span))))
    inside = (F.col("at") >= F.col("start_s")) & ((F.col("at") <= F.col("end_s")) if closed else (F.col("at") < F.col("end_s")))
    return points.join(c, (points[key] == F.col("_k")) & (F.floor(points["at"] / span) == F.col("_c")) & inside, "left").select(*[points[x] for x in points.columns], "hit")


def spread(pieces: DataFrame, key: list[str]) -> DataFrame:
    """``pieces`` (key, k, text, start_s, end_s of the whole) with their own times, by characters; the last ends exactly
    with the whole."""
    w = Window.partitionBy(*key)
    up_to = w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text")
    done, total = F.sum(n).over(up_to), F.sum(n).over(w)
    length = F.col("end_s") - F.col("start_s")
    last = F.col("k") == F.max("k").over(w)
    return pieces.select(*key, "k", (F.col("start_s") + length * (done - n) / total).alias("piece_start"), F.when(last, F.col("end_s")).otherwise(F.col("start_s") + length * done / total).alias("piece_end"))


def paired(a: DataFrame, b: DataFrame, key: str, place: str) -> DataFrame:
    """Rows of both sides at the same place; a place that only one side has raises."""
    x, y = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    both = x.join(y, [key, place], "full")
    whole = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.concat(F.lit("no partner at "), F.col(place).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(whole).drop("_a", "_b")


def chunked(rows: DataFrame, key: str, order: list[Column], size: int = 25) -> DataFrame:
    """Adds ``chunk``: numbers of runs of ``size`` rows of a key in order."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))
