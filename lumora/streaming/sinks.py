"""Where messages go: files per micro-batch that a replay writes over, dead letters, live counts, restarts after a break."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumora.streaming.progress import FAULTS, fault, rocksdb
from lumora.streaming.states import status_changes

log = logging.getLogger(__name__)


def subscribed(rows: DataFrame, pattern: str) -> DataFrame:
    """Messages of the channels that a glob names (* for any text, ? for any character, [..] for one of a set). What stands before
    the first sign of the glob is a prefix that the reader of the files gets as a filter."""
    prefix = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    kept = rows.where(F.col("channel").startswith(prefix)) if prefix else rows.where("channel IS NOT NULL")
    if pattern == prefix:
        return rows.where(F.col("channel") == pattern)
    if pattern == prefix + "*":
        return kept
    parts = re.findall(r"\[\^?[^\]]+\]|.", pattern, re.S)
    return kept.where(F.col("channel").rlike("(?s)^" + "".join({"*": ".*", "?": "."}.get(p, p if len(p) > 1 else re.escape(p)) for p in parts) + "$"))


def supervised(start: Callable[[], StreamingQuery], attempts: int = 5, pause_s: float = 3.0) -> StreamingQuery:
    """Runs a query to its end; after a failure ``start`` makes it anew, from its checkpoint, ``pause_s`` later. The last failure
    is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            q = start()
            q.awaitTermination()
            return q
        except Exception as e:
            if not left:
                raise
            log.warning("stream broke, starts again in %s s: %s", pause_s, e)
            time.sleep(pause_s)
    raise ValueError("attempts must be positive")


class Delivery(NamedTuple):
    """What a run of ``deliver`` has written so far, and the messages that this run counted: good, by fault, and not sent."""

    good: DataFrame
    dead: DataFrame
    counts: dict[str, int]


def deliver(stream: DataFrame, folder: str, send: Callable[[DataFrame, int], None] | None = None, attempts: int = 1, pause_s: float = 3.0) -> Delivery:
    """Writes the messages available now under ``folder`` in one pass a batch: good ones to kind=good, dead letters with their fault
    to kind=dead. A batch that runs again writes over its own folder, so nothing stands twice.

    ``send`` may pass a batch's good messages on, live; a failure there is logged, counted and swallowed, since losing
    a live message must not stop the work. The other counts are observed while the batch is written.
    """
    spark, at, counts = stream.sparkSession, f"{folder}/messages", dict.fromkeys(("good", *FAULTS, "unsent"), 0)
    kinds = stream.withColumn("fault", fault()).withColumn("kind", F.when(F.col("fault").isNull(), "good").otherwise("dead"))

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        told = batch.observe(seen, F.count_if(F.col("fault").isNull()).alias("good"), *[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS])
        told.write.mode("overwrite").partitionBy("kind").parquet(f"{at}/batch={number}")
        for k, n in seen.get.items():
            counts[k] += n
        if send:
            good = spark.read.schema(stream.schema).parquet(f"{at}/batch={number}/kind=good") if seen.get["good"] else stream.sparkSession.createDataFrame([], stream.schema)
            try:
                send(good, number)
            except Exception:
                log.warning("batch %s was not passed on", number, exc_info=True)
                counts["unsent"] += seen.get["good"]

    supervised(lambda: kinds.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(), attempts, pause_s)
    every = spark.read.schema(f"{stream.schema.toDDL()}, fault string, kind string, batch long").option("basePath", at).parquet(at)
    return Delivery(every.where("kind = 'good'").select(*stream.columns, "batch"), every.where("kind = 'dead'").select(*stream.columns, "fault", "batch"), counts)


def recounted(stream: DataFrame, folder: str) -> DataFrame:
    """(status, n) of the topics by their newest status, after all messages available now.

    Each batch's changes are summed by status and written over the batch's folder; the counts are the sum of all changes,
    so a restart or a batch that runs again leaves them exact. Counts that came to nothing are left out.
    """
    at = f"{folder}/changes"

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("status").agg(F.sum("delta").alias("delta")).write.mode("overwrite").parquet(f"{at}/batch={number}")

    spark = stream.sparkSession
    with rocksdb(spark):
        q = status_changes(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    sums = spark.read.schema("status string, delta long, batch long").option("basePath", at).parquet(at).groupBy("status").agg(F.sum("delta").alias("n"))
    return sums.where("n <> 0")
