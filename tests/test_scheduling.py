"""Schedules against posts served one by one."""

import random

import pytest

from lumora.operators import scheduling as op

POSTS, CHANNELS = "video long, channel string, score double", "channel string, hours array<int>, golden array<int>, quota int, gap int"


def one_by_one(posts, channels, days):
    known, of_video, of_channel, out = {c[0]: c for c in channels}, {}, {}, {}
    for video, channel, _ in sorted(posts, key=lambda p: (-p[2], p[0], p[1])):
        out[video, channel] = None
        if channel not in known:
            continue
        _, hours, golden, quota, gap = known[channel]
        own = of_channel.setdefault(channel, [])
        best = sorted((24 * d + h for d in range(days) for h in hours), key=lambda t: (-(10 * (t % 24 in golden) - 5 * (t % 24 >= 22)), t))
        for t in best:
            if sum(o // 24 == t // 24 for o in own) < quota and all(abs(o - t) >= max(1, gap) for o in own) and all(abs(o - t) >= 6 for o in of_video.get(video, ())):
                own.append(t)
                of_video.setdefault(video, []).append(t)
                out[video, channel] = t
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_as_if_served_one_by_one(spark, seed):
    rng = random.Random(seed)
    channels = [(f"c{i}", sorted(rng.sample(range(24), rng.randint(2, 9))), rng.sample(range(24), 4), rng.randint(1, 3), rng.randint(0, 5)) for i in range(4)]
    posts = [(v, c, float(rng.randrange(6))) for v in range(25) for c in rng.sample(["c0", "c1", "c2", "c3", "none"], rng.randint(1, 4))]
    got = {(r.video, r.channel): r["at"] for r in op.scheduled(spark.createDataFrame(posts, POSTS), spark.createDataFrame(channels, CHANNELS), 3).collect()}
    want = one_by_one(posts, channels, 3)
    assert got == want and any(t is None for (_, c), t in want.items() if c != "none")


def test_fifteen_videos_in_five_days_and_odd_rows(spark):
    channels = spark.createDataFrame([("a", [9, 12, 20], [20], 3, 3), ("b", None, None, None, None)], CHANNELS)
    posts = spark.createDataFrame([(v, "a", float(v)) for v in range(15)] + [(1, "a", 1.0), (1, "b", 1.0), (None, "a", 9.0)], POSTS)
    rows = op.scheduled(posts, channels, 5).collect()
    times = sorted(r["at"] for r in rows if r["at"] is not None)
    assert len(rows) == 18 and times == sorted(24 * d + h for d in range(5) for h in (9, 12, 20))
    assert {r.video: r["at"] for r in rows if r.channel == "a" and r["at"] is not None}[14] == 20
    assert op.scheduled(posts.limit(0), channels, 5).collect() == []
