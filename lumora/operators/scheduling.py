"""Posts spread over the free slots of channels. Beyond the reference's code: it plans this, without code."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.operators.order import checkpointed

#: Points of a golden hour and of a late one, the first late hour, and hours between a video's posts on two channels.
GOLDEN, LATE, LATE_FROM, APART = 10, -5, 22, 6


def slots_of(hours: list[int], golden: list[int], days: int) -> list[int]:
    """A channel's slots, as hours from the start of the first day: the best first, of equal ones the earliest."""
    points = lambda h: GOLDEN * (h in golden) + LATE * (h >= LATE_FROM)
    return sorted((24 * d + h for d in range(days) for h in sorted(set(hours)) if 0 <= h < 24), key=lambda t: (-points(t % 24), t))


def _filled(days: int):
    """Posts in the order of channel and rank, each put into its channel's best slot that is free for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, open_, left = None, [], {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["channel"] != channel:
                    channel, open_, left = r["channel"], slots_of(r["hours"] or [], r["golden"] or [], days), dict.fromkeys(range(days), max(0, r["quota"] or 0))
                at = next((t for t in open_ if left[t // 24] and all(abs(t - o) >= APART for o in r["others"] or ())), None)
                if at is not None:
                    left[at // 24] -= 1
                    open_ = [t for t in open_ if abs(t - at) >= max(1, r["gap"] or 0)]
                out.append(at)
            yield pa.RecordBatch.from_arrays([b.column("video"), b.column("channel"), b.column("place"), pa.array(out, pa.int32())], ["video", "channel", "place", "at"])

    return run


def scheduled(posts: DataFrame, channels: DataFrame, days: int, max_rounds: int = 50) -> DataFrame:
    """(video, channel, at) for each of ``posts`` (video, channel, score): hours from the start, or null where no slot is left.

    ``channels``: (channel, hours, golden, quota, gap): hours of the day that are allowed and golden, posts a day, hours
    between posts. Posts are served by score, then video, then channel: each takes the best slot of its channel that
    keeps the quota, the gap, and APART hours from the posts of its video that were served before. Posts of
    unknown channels and repeated ones stay without a slot.

    A post hangs on those served before it, of its channel and of its video. A round serves every channel on its own, in
    one pass over its posts sorted by rank that holds the channel's slots alone, with the times that its videos' other
    posts had after the last round; what hangs on others over n changes of channel is right after n rounds, so once a
    round changes nothing all is as if served one by one.
    """
    known = channels.dropDuplicates(["channel"]).select(F.col("channel").alias("_c"), "hours", "golden", "quota", "gap")
    ranked = posts.where("video IS NOT NULL AND channel IS NOT NULL").groupBy("video", "channel").agg(F.max("score").alias("score"))
    rows = checkpointed(ranked.join(known, F.col("channel") == F.col("_c")).drop("_c").withColumn("place", F.struct((-F.col("score")).alias("s"), "video", "channel")))
    served = Window.partitionBy("video").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    now, before = rows.select("video", "channel", F.lit(None).cast("int").alias("at")), None
    for _ in range(max_rounds):
        told = rows.join(now, ["video", "channel"]).withColumn("others", F.collect_list("at").over(served))  # a video's channels
        dealt = told.repartition("channel").sortWithinPartitions("channel", "place")
        schema = f"video {rows.schema['video'].dataType.simpleString()}, channel {rows.schema['channel'].dataType.simpleString()}, place {rows.schema['place'].dataType.simpleString()}, at int"
        now = checkpointed(dealt.mapInArrow(_filled(days), schema).select("video", "channel", "at"))
        state = now.agg(F.count("at"), F.sum(F.xxhash64("video", "channel", "at").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"the schedule did not settle in {max_rounds} rounds")
    every = posts.select("video", "channel")
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("video", "channel").orderBy(F.lit(1))))
    return first.join(now, ["video", "channel"], "left").select("video", "channel", F.when(F.col("_n") == 1, F.col("at")).alias("at"))
