"""Slots of dubbed sentences: how much each may be sped up to fit before the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators.intervals import with_next_start

#: Breath before the next sentence, highest speed, speed that counts as sped up, overflow that counts.
BREATH, FASTEST, SPED_UP, OVERFLOW, AT_LIMIT = 0.08, 1.5, 1.01, 0.05, 1.49


def slot(start: Column, next_start: Column) -> Column:
    return F.greatest(F.lit(0.0), next_start - BREATH - start)


def speed(voice: Column, room: Column) -> Column:
    """1 where the voice fits or there is no room, else as fast as needed and allowed."""
    return F.when((room <= 0) | (voice <= room), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(FASTEST), voice / room)))


def scheduled(cues: DataFrame, key: str = "video_id") -> DataFrame:
    """``cues`` (key, i, start_s, voice_s) with slot, factor, length, ends: rows without a voice are dropped, after they
    counted as the next of the one before; the last row's slot is its own length."""
    rows = with_next_start(cues, key)
    room = F.when(F.col("next_start").isNull(), F.col("voice_s")).otherwise(slot(F.col("start_s"), F.col("next_start")))
    rows = rows.where(F.col("voice_s") > 0).withColumn("slot", room)
    rows = rows.withColumn("factor", speed(F.col("voice_s"), F.col("slot")))
    return rows.withColumn("length", F.col("voice_s") / F.col("factor")).withColumn("ends", F.col("start_s") + F.col("length"))


def single(start: Column, next_start: Column, voice: Column) -> tuple[Column, Column, Column]:
    """(slot, factor, overflow) of one sentence; without a voice or a next one: 0, 1, 0."""
    none = voice.isNull() | (voice <= 0) | next_start.isNull()
    room = F.when(none, F.lit(0.0)).otherwise(slot(start, next_start))
    factor = F.when(none, F.lit(1.0)).otherwise(speed(voice, room))
    return room, factor, F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), voice / factor - room))
