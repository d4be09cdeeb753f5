"""Measures of a voice sample from the encoder's log, and their quality gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest and longest sample in seconds, peak that clips, mean level that is too low, share of silence.
SHORTEST, LONGEST, CLIPS, QUIET, SILENT = 7.0, 15.0, 0.99, 0.02, 0.40


def silence_share(log: Column, duration: Column) -> Column:
    """Sum of the log's ``silence_duration: x`` over the duration, to 4 places; 0 for no duration."""
    spans = F.regexp_extract_all(log, F.lit(r"silence_duration:\s*([0-9.]+)"), F.lit(1))
    total = F.aggregate(spans, F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return F.when(duration > 0, F.round(total / duration, 4)).otherwise(F.lit(0.0))


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def warnings(duration: Column, rms: Column, peak: Column, silence: Column) -> Column:
    """All that is wrong with a sample, in a fixed order; empty if nothing is."""
    return F.array_compact(F.array(
        F.when(duration < SHORTEST, "too_short").when(duration > LONGEST, "too_long"), F.when(peak >= CLIPS, "clipped"),
        F.when(rms < QUIET, "too_quiet"), F.when(silence > SILENT, "too_silent"),
    ))
