"""Streams with sinks and states: replayed batches, dead letters, patterns, restarts, counts kept by changes, runs that close."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from lumora.streaming import progress, sinks, states

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


@pytest.fixture
def log(spark, tmp_path):
    """(put, stream) of a folder of messages."""

    def put(*rows):
        spark.createDataFrame([(c, p, at(s)) for c, p, s in rows], progress.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put()
    return put, progress.messages(spark, str(tmp_path / "in"))


def forget_last_commit(folder):
    """As if the query had died after its last batch had written and before it was noted."""
    last = max(glob.glob(f"{folder}/progress/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_two_sinks_and_a_replayed_batch(log, tmp_path):
    put, stream = log
    out = str(tmp_path / "out")
    put(("media:status:7", "{}", 0), ("other:x", "{}", 1), ("media:alert", "{broken", 2), ("media:queue", None, 3))
    first = sinks.deliver(stream, out)
    assert first.counts == {"good": 1, "channel": 1, "json": 2, "unsent": 0}
    assert [r.channel for r in first.good.collect()] == ["media:status:7"]
    assert sorted((r.channel, r.fault) for r in first.dead.collect()) == [("media:alert", "json"), ("media:queue", "json"), ("other:x", "channel")]
    forget_last_commit(out)
    again = sinks.deliver(stream, out)
    assert again.counts["good"] == 1 and again.good.count() == 1 and again.dead.count() == 3
    put(("media:status:8", "{}", 9))
    assert sorted(r.channel for r in sinks.deliver(stream, out).good.collect()) == ["media:status:7", "media:status:8"]


def test_a_failing_receiver_stops_nothing(log, tmp_path):
    put, stream = log
    put(("media:queue", "{}", 0), ("media:queue", "{}", 1), ("x", "{}", 2))
    sent = []

    def send(batch, number):
        sent.append((number, batch.count()))
        raise OSError("gone")

    got = sinks.deliver(stream, str(tmp_path / "out"), send)
    assert got.counts == {"good": 2, "channel": 1, "json": 0, "unsent": 2} and sent == [(0, 2)] and got.good.count() == 2


def test_patterns_reach_the_reader(spark, tmp_path):
    names = ["media:status:1", "media:status:22", "media:progress:1", "media:alert", "mediaXstatus:1", None, "media:status:1\n2"]
    spark.createDataFrame([(n, "{}", T0) for n in names], progress.SCHEMA).write.parquet(str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m"))
    found = lambda p: {r.channel for r in sinks.subscribed(rows, p).collect()}
    assert found("media:*") == {n for n in names if n and n.startswith("media:")}
    assert found("media:status:?") == {"media:status:1"} and found("media:*:1") == {"media:status:1", "media:progress:1"}
    assert found("media:status:*[2]") == {"media:status:22", "media:status:1\n2"} and found("media:alert") == {"media:alert"} and found("*") == {n for n in names if n}
    plan = sinks.subscribed(rows, "media:st*:1")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(channel,media:st)" in plan


def test_a_break_repeats_no_message(log, spark, tmp_path):
    put, stream = log
    for i in range(4):
        put((f"media:status:{i}", "{}", i))
    slow = progress.messages(spark, str(tmp_path / "in"), files_at_once=1)
    calls = []

    def write(batch, number):
        calls.append(number)
        if len(calls) == 3:
            raise OSError("the connection broke")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    start = lambda: slow.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start()
    sinks.supervised(start, attempts=2, pause_s=0)
    got = [r.channel for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == [f"media:status:{i}" for i in range(4)]
    with pytest.raises(ZeroDivisionError):
        sinks.supervised(lambda: 1 / 0, attempts=2, pause_s=0)


def test_counts_by_changes_equal_the_batch(log, spark, tmp_path):
    put, stream = log
    out = str(tmp_path / "out")
    status = lambda v, s, t: (f"media:status:{v}", f'{{"status":"{s}"}}', t)
    parts = [
        [status(1, "running", 0), status(2, "running", 0), status(3, "queued", 5)],
        [status(1, "ready", 9), status(2, "error", 3), status(2, "running", 7), ("media:status:9", "{bad", 1), ("media:progress:4", "{}", 1)],
        [status(1, "running", 8), status(3, "queued", 6), status(2, "ready", 7)],
    ]
    for rows in parts:
        put(*rows)
        got = {r.status: r.n for r in sinks.recounted(stream, out).collect()}
        every = spark.read.schema(progress.SCHEMA).parquet(str(tmp_path / "in"))
        newest = progress.parsed(every).where("bad IS NULL AND channel LIKE 'media:status:%'").groupBy("topic").agg(F.max(F.struct("ingest_ts", "status"))["status"].alias("status"))
        assert got == {r.status: r["count"] for r in newest.groupBy("status").count().collect()}
    forget_last_commit(out)
    assert {r.status: r.n for r in sinks.recounted(stream, out).collect()} == got == {"ready": 1, "running": 1, "queued": 1}


def test_runs_close_by_time_whatever_batch_brings_them(spark, tmp_path):
    schema = "video_id long, step int, kind string, at timestamp, log string"

    def put(*rows):
        spark.createDataFrame([(v, s, k, at(t), g) for v, s, k, t, g in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def closed():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        rows = progress.drained(states.lifecycle(stream, seconds=100, late="50 seconds"), str(tmp_path / "out")).collect()
        return sorted((r.video_id, r.step, (r.started_at - T0).total_seconds(), r.status, r.duration_sec, r.log) for r in rows), rows

    put((1, 0, "success", 12, "ok"), (2, 0, "start", 5, None), (3, 1, "success", 1, "no run"), (4, 0, "start", 20, None))
    assert closed()[0] == []
    put((1, 0, "start", 10, None), (2, 0, "start", 30, None), (9, 9, "success", 100, None))  # the start of 1 comes after its end
    got, _ = closed()
    assert got == [(1, 0, 10.0, "success", 2.0, "ok"), (2, 0, 5.0, "failed", 25.0, states.SUPERSEDED)]
    put((2, 0, "failed", 60, "x" * 9000), (9, 9, "success", 300, None))
    got, rows = closed()
    assert got[2:] == [(2, 0, 30.0, "failed", 30.0, "x" * 8000), (4, 0, 20.0, "failed", 100.0, states.EXPIRED)]
    errors = [(r.video_id, r.error) for r in sorted(rows, key=lambda r: (r.video_id, r.started_at))]
    assert errors == [(1, None), (2, "0: started again"), (2, "0: " + "x" * 1997), (4, "0: no end in time")]


def test_one_state_holds_many_steps(spark, tmp_path):
    rows = [(v, s, k, at(t + v), k) for v in range(20) for s in (0, 1) for k, t in (("start", 1), ("success", 9 + s), ("start", 40))]
    rows += [(None, 0, "start", at(3), "n"), (None, 0, "failed", at(8), "n"), (7, None, "start", at(4), "n"), (7, None, "start", at(6), "n"), (99, 0, "start", at(500), "n")]
    schema = "video_id long, step int, kind string, at timestamp, log string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = [states.lifecycle(stream, seconds=100, groups=g) for g in (1, 7)]
    got = [sorted((tuple(r) for r in progress.drained(x, str(tmp_path / f"out{i}")).select("video_id", "step", "status", "duration_sec").collect()), key=str) for i, x in enumerate(got)]
    want = [(v, s, k, t) for v in range(20) for s in (0, 1) for k, t in (("success", 8.0 + s), ("failed", 100.0))]
    want += [(None, 0, "failed", 5.0), (7, None, "failed", 2.0), (7, None, "failed", 100.0)]
    assert got[0] == got[1] == sorted(want, key=str)


def test_a_client_gets_all_its_topics(spark):
    n = progress.MOST_TOPICS + 100
    subs = spark.range(n).selectExpr("1 AS client", "'video:' || id AS topic")
    rows = spark.range(n).selectExpr("'media:status:' || id AS channel", "'{\"status\":\"ready\"}' AS payload", "timestamp'2024-01-01 00:00:00' AS ingest_ts")
    assert progress.delivered(rows, subs).count() == n
    assert progress.delivered(rows, subs, progress.MOST_TOPICS).count() == progress.MOST_TOPICS
