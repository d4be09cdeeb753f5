"""State changes and configuration as expressions: guards, overlays, precedence, retry plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages' steps.
BEFORE = ("download", "probe", "transcribe")
TRANSLATE = ("translate", "format_sub", "tts")
FINISH = ("detect", "inpaint", "render")


def bulk_reason(action: str) -> Column:
    """Why a picked video (found, deleted, status) is left out of a bulk action; null if it is not."""
    wrong = {"approve": F.col("status") != "review", "mark_posted": ~F.col("status").isin("ready", "scheduled", "posted")}.get(action, F.lit(False))
    return F.when(~F.col("found"), "not found").when(F.coalesce(F.col("deleted"), F.lit(False)), "deleted").when(wrong, "wrong status")


def after(action: str) -> Column:
    """The status after an action that is allowed; others keep it."""
    s = F.col("status")
    return {
        "approve": F.when(s == "review", "ready").otherwise(s), "retry": F.when(s.isin("skipped", "error"), "queued").otherwise(s),
        "mark_posted": F.when(s.isin("ready", "scheduled", "posted"), "posted").otherwise(s), "translate": F.when(translate_refused().isNull(), "queued").otherwise(s),
    }[action]


def translate_refused(waiting: Column | None = None) -> Column:
    """Why a translation may not start: done, busy, or (``waiting``) already translated; null if it may."""
    s = F.col("status")
    again = (waiting if waiting is not None else F.lit(False)) & (s == "review")
    return F.when(s == "error", F.lit(None)).when(s.isin("ready", "posted"), "done").when(s != "review", "busy").when(again, "translated")


def overlaid(base: Column, over: Column) -> Column:
    """A map with the entries of both, those of ``over`` first in precedence."""
    b = F.coalesce(base, F.create_map().cast("map<string,string>"))
    o = F.coalesce(over, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)


def without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def target_platforms(config: Column, default: str = "tiktok") -> Column:
    """``target_platforms`` of a JSON configuration, a list or one name; the default if missing or empty."""
    raw = F.get_json_object(config, "$.target_platforms")
    many = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    one = F.when(~raw.startswith("[") & (raw != ""), F.array(raw))
    return F.coalesce(F.when(F.size(many) > 0, many), one, F.array(F.lit(default)))


def known_names(names: Column, known: tuple[str, ...]) -> Column:
    """struct<names, unknown>: names trimmed and in lower case, once each in order, and those that are not known, sorted;
    any unknown one refuses the batch."""
    clean = F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))
    return F.struct(clean.alias("names"), F.array_sort(F.array_except(clean, F.array(*[F.lit(k) for k in known]))).alias("unknown"))


def retry_steps(step: Column, automatic: Column) -> Column:
    """Steps to run again from ``step``: the rest of its stage; a step that is empty or unknown starts over."""
    lit = lambda steps: F.array(*[F.lit(s) for s in steps])
    first = F.when(automatic, lit((*BEFORE, *TRANSLATE, *FINISH))).otherwise(lit(BEFORE))
    rest = lambda steps: F.slice(steps, F.greatest(F.array_position(steps, step), F.lit(1)).cast("int"), F.size(steps))
    out = F.when(F.array_contains(first, step), rest(first)).otherwise(first)
    for stage in (TRANSLATE, FINISH):
        out = F.when(step.isin(*stage), rest(lit(stage))).otherwise(out)
    return out


def voice_params(provider: Column, code: Column, model: Column, voice_id: Column) -> Column:
    """A voice as parameters; the model only if there is one."""
    base = F.create_map(F.lit("tts_provider"), provider, F.lit("giong_doc"), F.coalesce(code, F.lit("")), F.lit("giong_doc_id"), voice_id.cast("string"))
    return F.when(F.coalesce(model, F.lit("")) == "", base).otherwise(F.map_concat(base, F.create_map(F.lit("tts_model"), model)))


def limit_violations() -> Column:
    """What is wrong with a row of limits, in a fixed order; empty if nothing is."""
    checks = [F.when(F.coalesce(F.col(c) <= 0, F.lit(True)), c) for c in ("title_len", "desc_len", "hashtags", "daily")]
    checks += [F.when(F.coalesce(F.col("max_sec") < 0, F.lit(True)), "max_sec")]
    checks += [F.when(F.coalesce(~((F.col(c) >= 0) & (F.col(c) < 0.5)), F.lit(True)), c) for c in ("sa_top", "sa_bottom", "sa_left", "sa_right")]
    checks += [F.when(F.col("sa_top") + F.col("sa_bottom") > 0.6, "vertical"), F.when(F.col("sa_left") + F.col("sa_right") > 0.6, "horizontal")]
    return F.array_compact(F.array(*checks))


def patched(cues: DataFrame, edits: DataFrame, key: str = "video_id") -> DataFrame:
    """Cues with the texts of ``edits`` (key, i, new_txt), which set ``edited``; times stay. A blank or unknown edit raises."""
    e = edits.withColumn("_e", F.lit(True))
    both = cues.withColumn("_c", F.lit(True)).join(e, [key, "i"], "full")
    wrong = F.col("_c").isNull() | (F.col("_e").isNotNull() & (F.trim(F.coalesce("new_txt", F.lit(""))) == ""))
    ok = F.when(wrong, F.raise_error(F.concat(F.lit("no such cue or no text: "), F.col("i").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(ok).withColumn("edited", F.col("_e").isNotNull()).withColumn("txt", F.coalesce("new_txt", "txt")).drop("_c", "_e", "new_txt")


def retranslated(old: DataFrame, new: DataFrame, key: str = "video_id") -> DataFrame:
    """Old cues with new texts (key, i, new_txt) where there is one and the old was not edited by hand; times stay."""
    rows = old.join(new, [key, "i"], "left")
    return rows.withColumn("txt", F.when(F.col("edited"), F.col("txt")).otherwise(F.coalesce("new_txt", "txt"))).drop("new_txt")


def ingested(links: DataFrame, existing: DataFrame) -> DataFrame:
    """(pos, platform, source_id, outcome) of links (pos, url) against the library (platform, source_id, deleted): invalid,
    duplicate (alive, or earlier in the batch), revived or created."""
    from lumora.functions.urls import source

    rows = links.withColumn("_s", source(F.col("url"))).select("pos", F.col("_s.platform").alias("platform"), F.col("_s.id").alias("source_id"))
    first = F.row_number().over(Window.partitionBy("platform", "source_id").orderBy("pos")) == 1
    rows = rows.withColumn("_first", first).join(existing, ["platform", "source_id"], "left")
    outcome = F.when(F.col("source_id").isNull(), "invalid").when((F.col("deleted") == F.lit(False)) | ~F.col("_first"), "duplicate").when(F.col("deleted"), "revived").otherwise("created")
    return rows.select("pos", "platform", "source_id", outcome.alias("outcome"))
