"""Streams with a state per key: runs of steps that always close, and changes of status that keep counts exact."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumora.streaming.progress import LOCK_S, LOG_CHARS, MESSAGE_CHARS, parsed

#: What stands in the log of a run that another start of its step ended, or that nothing ended.
SUPERSEDED, EXPIRED = "started again", "no end in time"

#: States that the steps are dealt over.
GROUPS = 256

RUNS = "video_id long, step int, started_us long, finished_us long, status string, log string"


class Runs(StatefulProcessor):
    """Events of the (video, step)s of one group, held until the watermark has passed them, then taken in the order of their times.
    The group's state is read and written as a whole, so that a call to the state server serves many steps."""

    def __init__(self, life_us: int) -> None:
        self.life = life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "video_id long, step int, at long, kind string, log string")
        self.open = handle.getListState("open", "video_id long, step int, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [((*_step(r.video_id, r.step), int(r.us), r.kind, r.log)) for b in rows for r in b.itertuples()]
        self.pending.appendList(new)
        self.handle.registerTimer(-(-min(x[2] for x in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for x in self.pending.get():
            (due if x[2] <= now else later).append((*_step(x[0], x[1]), *x[2:]))
        since = {_step(x[0], x[1]): x[2] for x in self.open.get()}
        held, out = bool(since), []

        def close(own: tuple, at: int, status: str, log: str | None) -> None:
            out.append((*own, since.pop(own), at, status, (log or "")[:LOG_CHARS]))

        for video, step, at, kind, log in sorted(due, key=lambda x: x[2:4]):
            own = (video, step)
            if own in since and at - since[own] > self.life:
                close(own, since[own] + self.life, "failed", EXPIRED)
            if kind == "start":
                if own in since:
                    close(own, at, "failed", SUPERSEDED)
                since[own] = at
            elif own in since:
                close(own, at, kind, log)
        for own in [x for x, at in since.items() if at + self.life <= now]:
            close(own, since[own] + self.life, "failed", EXPIRED)
        if due:
            self.pending.put(later) if later else self.pending.clear()
        if since:
            self.open.put([(*own, at) for own, at in since.items()])
        elif held:
            self.open.clear()
        if later or since:
            self.handle.registerTimer(-(-min([x[2] for x in later] + [at + self.life for at in since.values()]) // 1000))
        if out:
            columns = {"video_id": "Int64", "step": "Int32", "started_us": "int64", "finished_us": "int64", "status": "object", "log": "object"}
            yield pd.DataFrame(out, columns=list(columns)).astype(columns)


def _step(video: object, step: object) -> tuple[int | None, int | None]:
    return (None if pd.isna(video) else int(video), None if pd.isna(step) else int(step))


def lifecycle(events: DataFrame, seconds: float = LOCK_S, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """Closed runs of a stream (video_id, step, kind, at, log), kind being start, success or failed: each start opens one run, which
    the next end closes. A start while one is open, and ``seconds`` without an end, close it as failed; ends without a run are
    dropped. Logs are cut to LOG_CHARS, error messages to MESSAGE_CHARS.

    Events count by their time, whatever micro-batch brings them, if they are at most ``late``: they wait in the state until the
    watermark has passed them, by timers, and only open runs and waiting events are kept. Ends come before starts at
    one time. Steps are dealt over ``groups`` states by their hash, which a stream must keep from one start to the next: a state is read
    and written as a whole, and holds its share of the open runs and waiting events. Needs the RocksDB state store (``progress.drained`` sets it).
    """
    rows = events.select(F.col("video_id").cast("long").alias("video_id"), F.col("step").cast("int").alias("step"), "kind", "at", F.unix_micros("at").alias("us"), "log")
    group = F.pmod(F.xxhash64("video_id", "step"), F.lit(groups))
    held = rows.where("at IS NOT NULL AND kind IS NOT NULL").withColumn("group", group).withWatermark("at", late).groupBy("group")
    runs = held.transformWithStateInPandas(Runs(int(seconds * 1_000_000)), RUNS, "Append", "EventTime")
    error = F.when(F.col("status") == "failed", F.substring(F.concat_ws(": ", F.col("step").cast("string"), "log"), 1, MESSAGE_CHARS))
    return runs.select(
        "video_id", "step", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("finished_us").alias("finished_at"), "status",
        ((F.col("finished_us") - F.col("started_us")) / 1000000).alias("duration_sec"), "log", error.alias("error"),
    )


class Changes(StatefulProcessor):
    """The newest status of one topic; a change takes one from the old status and gives one to the new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        now = max([(int(r.us), r.status) for b in rows for r in b.itertuples()] + ([before] if before else []))
        if now != before:
            self.newest.update(now)
        if before is None or now[1] != before[1]:
            yield pd.DataFrame({"status": [now[1]] + ([before[1]] if before else []), "delta": [1] + ([-1] if before else [])})


def status_changes(rows: DataFrame) -> DataFrame:
    """(status, delta) of a stream of messages: what each batch changes in the number of topics by their newest status. Messages at
    one time count by the greater status, messages older than the known one not at all."""
    good = parsed(rows).where("bad IS NULL AND status IS NOT NULL AND ingest_ts IS NOT NULL AND channel LIKE 'media:status:%'")
    keyed = good.select("topic", F.unix_micros(F.col("ingest_ts").cast("timestamp")).alias("us"), "status").groupBy("topic")
    return keyed.transformWithStateInPandas(Changes(), "status string, delta long", "Update", "None")
