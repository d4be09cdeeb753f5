"""Aggregates: usage windows, costs, quotas, medians, progress."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lumora.functions.numeric import milestones, percent_of
from lumora.operators import usage as op
from lumora.plans.base import query
from lumora.sources import catalog as cat


@query("a12_calls_in_window", "SELECT count(*) AS calls FROM cost_logs, as_of WHERE service = 'llm_translate' AND created_at >= now - INTERVAL 86400 SECOND")
def a12(spark, sf):
    return op.usage(cat.cost_logs(spark, sf), cat.as_of(spark, sf)).select(F.col("calls_day").alias("calls"))


@query("a12b_calls_before_each", "SELECT id, count(*) OVER (PARTITION BY service ORDER BY created_at RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS calls FROM cost_logs WHERE service = 'llm_translate'")
def a12b(spark, sf):
    return op.calls_before_each(cat.cost_logs(spark, sf).where("service = 'llm_translate'"), 3600).select("id", "calls")


@query("a13_tokens_in_window", "SELECT CAST(coalesce(sum(quantity), 0) AS BIGINT) AS tokens FROM cost_logs, as_of WHERE service = 'llm_translate' AND unit = 'token' AND created_at >= now - INTERVAL 86400 SECOND")
def a13(spark, sf):
    return op.usage(cat.cost_logs(spark, sf), cat.as_of(spark, sf)).select(F.col("tokens_day").alias("tokens"))


@query("a14_month_to_date", "SELECT round(coalesce(sum(cost_usd), 0), 4) AS usd FROM cost_logs, as_of WHERE created_at >= date_trunc('month', now)")
def a14(spark, sf):
    return op.usage(cat.cost_logs(spark, sf), cat.as_of(spark, sf)).select(F.round("usd_month", 4).alias("usd"))


@query(
    "a15_usage_summary",
    """SELECT count(*) FILTER (WHERE service = 'llm_translate' AND created_at >= now - INTERVAL 60 SECOND) AS calls_minute,
      count(*) FILTER (WHERE service = 'llm_translate' AND created_at >= now - INTERVAL 86400 SECOND) AS calls_day,
      CAST(coalesce(sum(quantity) FILTER (WHERE service = 'llm_translate' AND unit = 'token' AND created_at >= now - INTERVAL 86400 SECOND), 0) AS BIGINT) AS tokens_day,
      round(coalesce(sum(cost_usd) FILTER (WHERE created_at >= date_trunc('month', now)), 0), 4) AS usd_month,
      15 AS cap_minute, 500 AS cap_day, 20.0e0 AS cap_usd FROM cost_logs, as_of""",
)
def a15(spark, sf):
    return op.summary(cat.cost_logs(spark, sf), cat.as_of(spark, sf), 15, 500, 20.0)


@query("c01_cost_estimate", "SELECT id, round_even(quantity / 1e6 * 0.37131e0 + (quantity * 2) / 1e6 * 2.41371e0, 6)::DOUBLE AS usd FROM cost_logs WHERE unit = 'token'")
def c01(spark, sf):
    q = F.col("quantity")
    return cat.cost_logs(spark, sf).where("unit = 'token'").select("id", op.estimated_cost(q, q * 2, 0.37131, 2.41371).alias("usd"))


@query("c02_cumulative_to_delta", "SELECT run, seq, total - coalesce(lag(total) OVER (PARTITION BY run ORDER BY seq), 0) AS delta FROM (SELECT l_orderkey AS run, l_extendedprice AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS seq FROM lineitem)")
def c02(spark, sf):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    rows = cat.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), place.cast("long").alias("seq"), F.col("l_extendedprice").alias("total"))
    return op.deltas(rows, "run", "seq", "total").select("run", "seq", "delta")


@query(
    "c03_running_usage",
    "SELECT id, count(*) OVER w AS requests, CAST(sum(quantity) OVER w AS BIGINT) AS tokens, CAST(sum(quantity + 7) OVER w AS BIGINT) AS total_tokens FROM cost_logs WHERE unit = 'token' WINDOW w AS (PARTITION BY video_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)",
)
def c03(spark, sf):
    rows = cat.cost_logs(spark, sf).where("unit = 'token'").withColumn("total", F.col("quantity") + 7)
    w = Window.partitionBy("video_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("id", F.count("*").over(w).alias("requests"), F.sum("quantity").over(w).cast("long").alias("tokens"), F.sum("total").over(w).cast("long").alias("total_tokens"))


@query(
    "c04_quota_gate",
    "SELECT video_id, CASE WHEN count(*) FILTER (WHERE service = 'llm_translate') >= 3 THEN 'day' WHEN round(sum(cost_usd), 9) >= 0.1e0 THEN 'usd' END AS blocked FROM cost_logs GROUP BY 1",
)
def c04(spark, sf):
    used = cat.cost_logs(spark, sf).groupBy("video_id").agg(F.count_if(F.col("service") == "llm_translate").alias("calls"), F.round(F.sum("cost_usd"), 9).alias("usd"))
    return used.select("video_id", op.quota_gate(F.col("calls"), F.col("usd"), F.lit(3), F.lit(0.1)).alias("blocked"))


@query("c05_paced", "SELECT id, count(*) OVER (ORDER BY created_at RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) - 1 >= 3 AS waits FROM cost_logs WHERE service = 'llm_translate'")
def c05(spark, sf):
    rows = cat.cost_logs(spark, sf).where("service = 'llm_translate'")
    return op.calls_before_each(rows, 3600).select("id", (F.col("calls") - 1 >= 3).alias("waits"))


@query("c06_median", "SELECT user_id, round(median(value), 6) AS median FROM events GROUP BY 1")
def c06(spark, sf):
    return cat.table(spark, sf, "events").groupBy("user_id").agg(F.round(F.median("value"), 6).alias("median"))


@query(
    "c07_subject_column",
    """SELECT video_id, round(least(greatest(coalesce(median(c), 0.5e0), 0.0703125e0), 0.9296875e0), 6) AS center FROM (
      SELECT video_id, CASE WHEN list_sum(d) > 0 THEN list_sum(list_transform(range(1, 65), lambda k: d[k] * ((k - 1) % 16))) / list_sum(d) / 16 END AS c FROM (
        SELECT video_id, list_transform(range(1, 65), lambda k: abs(CAST(b[k] AS DOUBLE) - CAST(a[k] AS DOUBLE))) AS d FROM (
          SELECT vec_id // 25 AS video_id, embedding AS b, lag(embedding) OVER (PARTITION BY vec_id // 25 ORDER BY vec_id) AS a FROM embeddings))) GROUP BY 1""",
)
def c07(spark, sf):
    from lumora.functions.kernels import subject_column

    frames = cat.table(spark, sf, "embeddings").groupBy((F.floor(F.col("vec_id") / 25)).alias("video_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("f"))
    rows = frames.select("video_id", F.transform("f", lambda x: F.transform(x["embedding"], lambda v: v.cast("double"))).alias("frames"))
    return rows.select("video_id", F.round(subject_column("frames", F.lit(4), F.lit(16)), 6).alias("center"))


@query(
    "c08_silence_share",
    "SELECT event_id AS id, CASE WHEN value > 0 THEN round(0.25e0 * (event_id % 4) / value, 4) ELSE 0 END AS silence, round(pow(10e0, -value / 20), 6) AS peak FROM events",
)
def c08(spark, sf):
    from lumora.functions.audio import amplitude, silence_share

    log = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("event_id") % 4, F.lit(1).cast("long"))), lambda k: F.when(F.col("event_id") % 4 > 0, F.lit("silence_duration: 0.25")).otherwise(F.lit(""))), "\n")
    e = cat.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), silence_share(log, F.col("value")).alias("silence"), F.round(amplitude(-F.col("value")), 6).alias("peak"))


@query("c11_milestones", "SELECT event_id AS id, list_sort(list_distinct(CASE WHEN event_id % 40 <= 5 THEN range(1, event_id % 40 + 1) ELSE list_transform(range(1, 6), lambda i: (event_id % 40) * i // 5) END)) AS marks, CASE WHEN event_id % 40 = 0 THEN 100 ELSE CAST(round_even(least(100, greatest(0, 100.0e0 * (event_id % 7) / (event_id % 40))), 0) AS INTEGER) END AS percent FROM events")
def c11(spark, sf):
    n = F.col("event_id") % 40
    return cat.table(spark, sf, "events").select(F.col("event_id").alias("id"), milestones(n).alias("marks"), percent_of(F.col("event_id") % 7, n).alias("percent"))


@query("c12_failure_gate", "SELECT video_id, count(*) FILTER (WHERE status = 'failed') > 0.34e0 * count(*) AS failed FROM job_runs GROUP BY 1")
def c12(spark, sf):
    return cat.job_runs(spark, sf).groupBy("video_id").agg((F.count_if(F.col("status") == "failed") > 0.34 * F.count("*")).alias("failed"))


@query(
    "c13_circuit_breaker",
    """SELECT video_id, min(place) AS stops_at FROM (
      SELECT video_id, place, count(*) FILTER (WHERE status = 'failed') OVER (PARTITION BY video_id, run ORDER BY place) AS fails
      FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY started_at, id) AS place, count(*) FILTER (WHERE status <> 'failed') OVER (PARTITION BY video_id ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS run FROM job_runs))
    WHERE fails >= 2 GROUP BY 1""",
)
def c13(spark, sf):
    return op.circuit_breaker(cat.job_runs(spark, sf).withColumn("failed", F.col("status") == "failed"), ["video_id"], [F.col("started_at"), F.col("id")], 2)


@query(
    "c14_bulk_result",
    "SELECT CASE WHEN v.id IS NULL THEN 'not found' WHEN v.deleted THEN 'deleted' WHEN v.status <> 'review' THEN 'wrong status' ELSE 'affected' END AS result, count(*) AS n FROM orders LEFT JOIN videos v ON v.id = o_custkey GROUP BY 1",
)
def c14(spark, sf):
    from lumora.operators.library import picked
    from lumora.operators.states import bulk_reason

    asked = cat.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    rows = picked(asked, cat.videos(spark, sf).select("id", "status", "deleted"))
    return rows.groupBy(F.coalesce(bulk_reason("approve"), F.lit("affected")).alias("result")).agg(F.count("*").alias("n"))
