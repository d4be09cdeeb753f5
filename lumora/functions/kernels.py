"""Numeric kernels on arrays of samples and frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Level below which a sample is silent, what stays after the last sound, peak of a mix, centre by default.
SILENT, TAIL_S, PEAK, CENTER = 0.005, 0.15, 0.99, 0.5


@F.pandas_udf(T.DoubleType())
def subject_column(frames: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Where motion is, as a share of the width: the median over adjacent frames (flat, row by row) of the energy-weighted
    column, held so that a 9:16 crop fits. Still pairs do not count; without motion the middle."""

    def one(f, h: int, w: int) -> float:
        half = min(h * (9 / 16) / 2 / w, 0.5) if w > 0 else 0.5
        stack = np.array([np.asarray(x, float) for x in f]).reshape(len(f), h, w)
        energy = np.abs(np.diff(stack, axis=0)).sum(1)  # pairs by columns
        moving = energy[energy.sum(1) > 0]
        at = float(np.median(moving @ np.arange(w) / moving.sum(1) / w)) if len(moving) else CENTER
        return float(np.clip(at, half, 1 - half))

    return pd.Series([one(f, h, w) for f, h, w in zip(frames, height, width)])


def _loud(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.abs(x) > SILENT)


def trimmed(samples: Column) -> Column:
    """Samples from the first sound to the tail after the last (24000 a second); empty if all is silent, null for null."""
    first, after = F.array_position(_loud(samples), True), F.array_position(F.reverse(_loud(samples)), True)
    kept = F.size(samples) - after - first + 2 + int(TAIL_S * 24000)
    return F.slice(samples, F.greatest(first, F.lit(1)).cast("int"), F.when(first > 0, kept).otherwise(0).cast("int"))


def silent_tail(samples: Column) -> Column:
    """Number of silent samples at the end; null for null."""
    after = F.array_position(F.reverse(_loud(samples)), True)
    return F.when(after > 0, after - 1).otherwise(F.size(samples)).cast("long")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def mixed_track(total: pd.Series, segments: pd.Series) -> pd.Series:
    """A track of ``total`` samples with the segments (at, samples) added up, cut at its end, and scaled down to the peak
    if above."""

    def one(n: int, segs) -> list:
        out = np.zeros(n)
        for s in segs:
            at, x = int(s["at"]), np.asarray(s["samples"], float)
            x = x[: max(0, n - at)]
            out[at : at + len(x)] += x
        top = np.abs(out).max() if n else 0
        return list(out * (PEAK / top) if top > PEAK else out)

    return pd.Series([one(n, s) for n, s in zip(total, segments)])
