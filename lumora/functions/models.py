"""Names of language models: what they can be used for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of names, and of families that take and give text.
TTS = r"-tts\b|-tts-|tts$"
UNUSABLE = r"image|imagen|banana|veo|video|lyria|embedding|computer-use|robotics|deep-research|antigravity|\baqa\b|live|native-audio"
AUDIO = r"-audio\b|-audio-"
FAMILIES = (
    r"^(gemini|gemma|gpt|o[34]\b|claude|llama|qwen|mistral|ministral|magistral|deepseek|grok|nemotron|glm|kimi|minimax|command|sonar|hermes|phi|yi"
    r"|solar|seed|nova|ling|olmo|granite|jamba|exaone|ernie|reka|arcee|apriel)"
)


def bare(name: Column) -> Column:
    """The name in lower case without ``models/`` and without a vendor before the first slash."""
    n = F.lower(F.regexp_replace(F.trim(name), "^models/", ""))
    return F.regexp_replace(n, "^[^/]*/", "")


def purpose(name: Column, outputs: Column | None = None) -> Column:
    """tts, translate or other: by name, then by the kinds of output if declared, then by family."""
    n = bare(name)
    by_family = F.when(n.rlike(FAMILIES), "translate").otherwise("other")
    by_output = by_family
    if outputs is not None:
        o = F.transform(outputs, F.lower)
        has = lambda *k: F.coalesce(F.arrays_overlap(o, F.array(*[F.lit(x) for x in k])), F.lit(False))
        only_text = F.coalesce(F.array_distinct(o) == F.array(F.lit("text")), F.lit(False))
        by_output = F.when(has("audio", "speech"), "tts").when(has("image", "video"), "other").when(only_text, "translate").otherwise(by_family)
    return F.when(n.rlike(TTS), "tts").when(n.rlike(UNUSABLE), "other").otherwise(by_output)


def cannot_translate(name: Column) -> Column:
    """Whether the name alone proves that the model cannot translate."""
    n = bare(name)
    return n.rlike(TTS) | n.rlike(UNUSABLE) | n.rlike(AUDIO)


def usable_for(names: Column, wanted: str) -> Column:
    """The names for a purpose, in order; for translation all of them if none is left."""
    kept = F.filter(names, lambda n: purpose(n) == wanted)
    return F.when(F.size(kept) == 0, names).otherwise(kept) if wanted == "translate" else kept


def listed(payload: Column) -> Column:
    """Names of the models in a provider's JSON: data, models or the bare list, of strings or objects with id, name or
    model; without ``models/``, sorted, once each; empty for other shapes."""
    part = F.when(payload.startswith("["), payload).otherwise(F.coalesce(_filled(payload, "$.data"), _filled(payload, "$.models")))
    items = F.coalesce(F.from_json(part, "array<string>"), F.array().cast("array<string>"))

    def name(x: Column) -> Column:
        given = F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("id", "name", "model")])
        return F.when(x.startswith("{"), F.regexp_replace(given, "^models/", "")).otherwise(x)

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(items, name))))


def _filled(payload: Column, path: str) -> Column:
    v = F.get_json_object(payload, path)
    return F.when(v != "[]", v)


def json_array(text: Column) -> Column:
    """The strings of the JSON array in a model's answer, fenced or not; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), "array<string>")
