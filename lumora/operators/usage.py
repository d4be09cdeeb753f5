"""Usage and budget accounting over the cost log. "Now" is always a parameter."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(costs: DataFrame, now: datetime.datetime | None) -> DataFrame:
    """One row: calls in the last minute and day, tokens of the last day, spend since the month began; bounds included."""
    if now is None:
        now = datetime.datetime(1970, 1, 1)
    at, llm = F.col("created_at"), F.col("service") == "llm_translate"
    since = lambda seconds: at >= F.lit(now - datetime.timedelta(seconds=seconds)).cast("timestamp_ntz")
    month = F.lit(now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)).cast("timestamp_ntz")
    return costs.agg(
        F.count_if(llm & since(60)).alias("calls_minute"), F.count_if(llm & since(86400)).alias("calls_day"),
        F.coalesce(F.sum(F.when(llm & (F.col("unit") == "token") & since(86400), F.col("quantity"))), F.lit(0.0)).cast("long").alias("tokens_day"),
        F.coalesce(F.sum(F.when(at >= month, F.col("cost_usd"))), F.lit(0.0)).alias("usd_month"),
    )


def summary(costs: DataFrame, now: datetime.datetime | None, cap_minute: int, cap_day: int, cap_usd: float) -> DataFrame:
    """``usage`` with the caps beside it (0: none)."""
    u = usage(costs, now).withColumn("usd_month", F.round("usd_month", 4))
    return u.select("*", F.lit(cap_minute).alias("cap_minute"), F.lit(cap_day).alias("cap_day"), F.lit(cap_usd).alias("cap_usd"))


def calls_before_each(costs: DataFrame, seconds: int, by: str = "service") -> DataFrame:
    """Adds ``calls``: the rows of the same ``by`` in the ``seconds`` up to each, itself and ties included.

    Long histories are cut into spans of the window's length; each row is counted within its own span and the one
    before, so one service's log is spread over its spans.
    """
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    step = seconds * 1_000_000
    rows = costs.withColumn("_t", micros).withColumn("_s", F.floor(micros / step))
    twice = rows.withColumn("_span", F.explode(F.array("_s", F.col("_s") + 1)))
    w = Window.partitionBy(by, "_span").orderBy("_t").rangeBetween(-step, 0)
    return twice.withColumn("calls", F.count("*").over(w)).where("_span = _s").drop("_t", "_s", "_span")


def estimated_cost(prompt: Column, completion: Column, usd_in: float, usd_out: float) -> Column:
    """Tokens by the million times their prices, to 6 places, half to even."""
    return F.bround(prompt / 1e6 * usd_in + completion / 1e6 * usd_out, 6)


def deltas(rows: DataFrame, run: str, seq: str, total: str) -> DataFrame:
    """Adds ``delta``: each snapshot of a cumulative counter less the one before it (the first less 0)."""
    w = Window.partitionBy(run).orderBy(seq)
    return rows.withColumn("delta", F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0)))


def quota_gate(calls: Column, usd: Column, cap_day: Column, cap_usd: Column) -> Column:
    """The first cap that is reached, "day" before "usd"; null if none is. A cap of 0 is none."""
    return F.when((cap_day > 0) & (calls >= cap_day), "day").when((cap_usd > 0) & (usd >= cap_usd), "usd")


def circuit_breaker(rows: DataFrame, key: list[str], order: list[Column], most: int = 5) -> DataFrame:
    """(key, stops_at): the place at which ``most`` failures (``failed``) in a row are first reached; a success resets."""
    w = Window.partitionBy(*key).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("place", F.row_number().over(w).cast("long")).withColumn("_run", F.count_if(~F.col("failed")).over(up_to))
    in_run = Window.partitionBy(*key, "_run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fails = placed.withColumn("_fails", F.count_if("failed").over(in_run))
    return fails.where(F.col("_fails") >= most).groupBy(*key).agg(F.min("place").alias("stops_at"))
