"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def milestones(total: Column) -> Column:
    """Five progress marks: floor(total * i / 5), or every step where there are five or fewer; ascending, once each."""
    total = total.cast("long")
    one = F.lit(1).cast("long")
    few = F.when(total >= 1, F.sequence(one, F.greatest(total, one))).otherwise(F.array().cast("array<bigint>"))
    many = F.transform(F.sequence(one, F.lit(5).cast("long")), lambda i: F.floor(total * i / 5))
    return F.array_sort(F.array_distinct(F.when(total <= 5, few).otherwise(many)))


def percent_of(done: Column, total: Column, lo: int = 0, hi: int = 100) -> Column:
    """Percentage between ``lo`` and ``hi``, half to even; ``hi`` where there is nothing to do."""
    share = F.lit(float(hi)) * done / F.when(total > 0, total)
    return F.when(total <= 0, F.lit(hi)).otherwise(F.bround(F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), share)), 0).cast("int"))


def between(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def once(value: Column) -> Column:
    """A generator of the one value: Spark merges projections, and computes a merged value anew wherever it is used, in a
    lambda for each element; it does not look behind a generator."""
    return F.explode(F.array(value))
