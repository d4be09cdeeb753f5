"""Values that the operators must give, for rows too few to need a table."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumora.functions import audio, formats, hashing, kernels, layout, models, subtitles, urls
from lumora.operators import boxes, intervals, library, similarity, states, usage, voices
from lumora.sources.catalog import LIMITS, LIMITS_SCHEMA
from lumora.streaming import progress

CUE = "video_id long, i long, start_s double, end_s double, txt string"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(column).first()[0]


def cues(spark, rows, video=1):
    return spark.createDataFrame([(video, i, float(s), float(e), t) for i, (s, e, t) in enumerate(rows)], CUE)


def array_of(spark, rows):
    made = spark.createDataFrame([([(i, float(s), float(e), t) for i, (s, e, t) in enumerate(rows)],)], f"cues {subtitles.CUES}")
    return made


def run(df, column):
    return [(r["i"], r["start"], r["end"], r["text"]) for r in df.select(column).first()[0]]


@pytest.mark.parametrize(
    ("dst", "src", "want"),
    [
        ([(0, 1, "a"), (1, 2, "b")], [(0, 1, "你好"), (1, 2, "再见")], ["你好", "再见"]),
        ([(0, 1.5, "a"), (1.5, 3, "b")], [(0, 3, "全")], ["全", "全"]),
        ([(0, 2, "a")], [(0, 1, "来"), (1, 2, "好嘞")], ["来 / 好嘞"]),
        ([(1, 2, "a")], [(0, 1, "x")], [""]),
        ([(100, 200, "a")], [(59, 61, "no"), (119, 121, "x"), (179, 250, "y")], ["x / y"]),
    ],
)
def test_alignment(spark, dst, src, want):
    got = intervals.aligned(cues(spark, dst), cues(spark, src)).orderBy("i").collect()
    assert [r["source"] for r in got] == want


def test_alignment_of_nothing(spark):
    got = intervals.aligned(cues(spark, [(3.25, 4.5, "a")]), cues(spark, []).limit(0)).collect()
    assert [(r["start_s"], r["end_s"], r["source"]) for r in got] == [(3.25, 4.5, "")]


def test_merge_short(spark):
    c = subtitles.merged_short(F.col("cues"))
    assert run(array_of(spark, [(0, 0.3, "A"), (0.4, 2, "B")]), c) == [(0, 0.0, 2.0, "A B")]
    assert run(array_of(spark, [(0, 2, "A"), (2.1, 2.3, "B")]), c) == [(0, 0.0, 2.3, "A B")]
    assert run(array_of(spark, [(0, 0.2, "A")]), c) == [(0, 0.0, 0.2, "A")]
    assert run(array_of(spark, [(0, 0.1, "A"), (0.1, 0.3, "B"), (0.3, 2, "C")]), c) == [(0, 0.0, 2.0, "A B C")]
    assert run(array_of(spark, []), c) == []


def test_timing(spark):
    c = subtitles.timed(F.col("cues"))
    assert run(array_of(spark, [(0, 0.5, "a"), (3, 3.1, "b")]), c) == [(0, 0.0, 1.2, "a"), (1, 3.0, 4.2, "b")]
    assert run(array_of(spark, [(0, 2, "a"), (1, 3, "b")]), c) == [(0, 0.0, 0.96, "a"), (1, 1.0, 3.0, "b")]
    got = run(array_of(spark, [(0, 2, "a"), (0.1, 3, "b"), (0.2, 1, "c")]), c)
    assert got == [(0, 0.0, 0.3, "a"), (1, 0.34, 0.64, "b"), (2, 0.68, 1.88, "c")]
    assert run(array_of(spark, []), c) == []


def test_wrap(spark):
    w = lambda t, n, k: one(spark, subtitles.wrapped(F.col("t"), n, k), t=t)
    assert w("x" * 30, 10, 2) == "x" * 30
    assert w("  ", 10, 2) == ""
    assert w("aa bb cc dd", 5, 2) == "aa bb\ncc dd"
    assert w("aa bb cc dd ee", 5, 2) == "aa bb\ncc dd ee"
    assert w(" ".join(["word"] * 60), 10, 2).count("\n") == 1


def test_split_long_cues(spark):
    text = "Một hai ba bốn, năm sáu bảy tám. Chín mười mười một mười hai mười ba mười bốn"
    got = run(array_of(spark, [(0, 8, text), (8, 9, "ngắn")]), subtitles.split_long(20, 1, 1.2)("cues"))
    assert " ".join(t for *_, t in got[:-1]) == text
    assert all(len(t) <= 20 for *_, t in got)
    assert got[0][1] == 0.0 and got[-2][2] == 8.0 and got[-1][1:] == (8.0, 9.0, "ngắn")
    assert [i for i, *_ in got] == list(range(len(got)))
    short = run(array_of(spark, [(0, 2.0, text)]), subtitles.split_long(20, 1, 1.2)("cues"))
    assert len(short) == 1  # time for one piece only


def test_format_keeps_order_of_steps(spark):
    df = array_of(spark, [(0, 0.2, " A  b "), (0.2, 3, "c"), (3, 4, "  ")])
    assert run(subtitles.formatted(df, "cues"), F.col("cues")) == [(0, 0.0, 3.0, "A b c")]


@pytest.mark.parametrize(
    ("total", "most", "cuts", "want"),
    [
        (600, 0, [], [600]),
        (3600, 0, [100, 2000], [3600]),
        (50, 60, [], [50]),
        (90, 90, [], [90]),
        (240, 180, [], [180, 240]),
        (240, 90, [85, 175], [85, 175, 240]),
        (95, 90, [], [85, 95]),
        (185, 90, [], [90, 175, 185]),
    ],
)
def test_parts(spark, total, most, cuts, want):
    df = spark.createDataFrame([(float(total), most, [float(c) for c in cuts])], "t double, m int, c array<double>")
    assert df.select(intervals.part_bounds(F.col("t"), F.col("m"), F.col("c"))).first()[0] == want


def test_parts_reject_negative(spark):
    df = spark.createDataFrame([(-1.0, 5, [])], "t double, m int, c array<double>")
    with pytest.raises(Exception, match="below 0"):
        df.select(intervals.part_bounds(F.col("t"), F.col("m"), F.col("c"))).collect()


def test_variant_plan(spark):
    lim = spark.createDataFrame([r if r[0] != "facebook" else (r[0], 90, *r[2:]) for r in LIMITS], LIMITS_SCHEMA).withColumn("max_sec", F.when(F.col("platform") == "facebook", 90).otherwise(180))
    video = spark.createDataFrame([(1, 200.0), (2, 60.0)], "video_id long, duration_sec double")
    targets = video.select("video_id", F.explode(F.array(*map(F.lit, ["tiktok", "youtube", "facebook"]))).alias("platform"))
    none = spark.createDataFrame([], "video_id long, cut double")
    got = intervals.parts(video, none, lim, targets).groupBy("video_id", "platform").agg(F.count("*").alias("n"), F.max("part_total").alias("t")).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == {(1, "tiktok"): (2, 2), (1, "youtube"): (2, 2), (1, "facebook"): (3, 3), (2, "tiktok"): (1, 1), (2, "youtube"): (1, 1), (2, "facebook"): (1, 1)}
    unknown = video.select("video_id", F.lit("myspace").alias("platform"))
    with pytest.raises(Exception, match="no limit for myspace"):
        intervals.parts(video, none, lim, unknown).collect()


def test_strict_pairs(spark):
    a, b = cues(spark, [(0, 1, "a"), (1, 2, "b")]), cues(spark, [(0, 1, "x")]).withColumnRenamed("txt", "u")
    with pytest.raises(Exception, match="no partner"):
        intervals.paired(a.select("video_id", "i", "txt"), b.select("video_id", "i", "u"), "video_id", "i").collect()


def test_voice_schedule(spark):
    def plan(rows):
        df = spark.createDataFrame([(1, i, float(s), float(v)) for i, (s, v) in enumerate(rows)], "video_id long, i long, start_s double, voice_s double")
        return {r["i"]: round(r["factor"], 6) for r in voices.scheduled(df).collect()}

    assert plan([(1, 2.9)]) == {0: 1.0}
    got = plan([(1, 3.0), (3, 1.0)])
    assert got[0] == 1.5 and got[1] == 1.0
    assert plan([(1, 1.0), (1.5, 0.0), (9, 1.0)]) == {0: 1.5, 2: 1.0}  # the silent one still ends the first one's slot


def test_usage_windows(spark):
    now = datetime.datetime(2024, 5, 20, 12)
    rows = []
    for n, back in ((3, 0), (2, 30), (5, 300), (4, 82800), (7, 90000)):
        rows += [("llm_translate", "token", 10.0, 0.5, now - datetime.timedelta(seconds=back))] * n
    rows += [("tts", "second", 5.0, 1.0, now)]
    df = spark.createDataFrame(rows, "service string, unit string, quantity double, cost_usd double, created_at timestamp_ntz")
    r = usage.usage(df, now).first()
    assert (r["calls_minute"], r["calls_day"], r["tokens_day"], r["usd_month"]) == (5, 14, 140, 21 * 0.5 + 1)
    assert usage.usage(df.limit(0), None).first()["calls_day"] == 0


def test_quota_gate(spark):
    g = lambda c, u, d, m: one(spark, usage.quota_gate(F.col("c"), F.col("u"), F.col("d"), F.col("m")), c=c, u=u, d=d, m=m)
    assert g(5, 9.0, 5, 9.0) == "day"
    assert g(4, 9.0, 5, 9.0) == "usd"
    assert g(4, 9.0, 0, 0.0) is None


A, B = "a1b2c3d4e5f60718" * 4, "0f1e2d3c4b5a6978" * 4


def test_originals(spark):
    near = f"{int(A, 16) ^ 0b111:064x}"
    rows = [(1, "m1", A, "ready"), (2, "m1", None, "review"), (3, "m3", near, "review"), (4, "m4", B, "review"), (5, "m1", None, "skipped"), (6, None, None, "review")]
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(*r, at + datetime.timedelta(minutes=r[0])) for r in rows], "id long, md5 string, phash string, status string, created_at timestamp_ntz")
    exact = {r["id"]: r["original"] for r in similarity.oldest_same(df).collect()}
    assert exact == {1: 2, 2: 1, 3: None, 4: None, 5: 1, 6: None}
    pairs = similarity.similar_pairs(df.where("phash IS NOT NULL"), df.where("phash IS NOT NULL"), 20, 64).collect()
    assert {(r["id"], r["other"], r["distance"]) for r in pairs} == {(1, 3, 3), (3, 1, 3)}


def test_hamming(spark):
    d = lambda a, b: one(spark, hashing.hamming_hex(F.col("a"), F.col("b")), a=a, b=b)
    assert d("f" * 16, "0" * 16) == 64
    assert d("ff", "fe") == 1
    assert d("ff", "fff") is None and d("zz", "ff") is None and d("", "") is None


def test_perceptual_hash(spark):
    import numpy as np

    g = np.random.default_rng(1).integers(0, 200, 1024).astype(float)
    n, k = np.arange(32), np.arange(8)
    direct = [sum(g[r * 32 + c] * np.cos(np.pi * (2 * r + 1) * u / 64) * np.cos(np.pi * (2 * c + 1) * v / 64) for r in n for c in n) for u in k for v in k]
    df = spark.createDataFrame([(1, g.tolist()), (2, (g + 20).tolist()), (3, g[:100].tolist())], "id int, gray array<double>")
    c = df.select("id", hashing.dct_low("gray").alias("c"))
    got = {r[0]: r[1] for r in c.collect()}
    assert np.allclose(got[1], direct) and got[3] is None
    h = {r[0]: r[1] for r in hashing.with_fingerprint(c.where("c IS NOT NULL"), "c").select("id", hashing.hex64(F.col("bits"))).collect()}
    assert h[1] == h[2] and len(h[1]) == 16


def test_distinct_lines_against_every_leader():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(1)
    for _ in range(60):
        base = ["".join(rng.choice("abcdeé漢 ") for _ in range(rng.randrange(20))) for _ in range(6)]
        lines = []
        for _ in range(rng.randrange(25)):
            t = list(rng.choice(base))
            for _ in range(rng.randrange(3) if t else 0):
                t[rng.randrange(len(t))] = rng.choice("abz")
            lines.append("".join(t))
        leaders = []
        for x in dict.fromkeys(" ".join(x.split()) for x in lines):
            if x and all(SequenceMatcher(None, x, y).ratio() < 0.75 for y in leaders):
                leaders.append(x)
        assert similarity.distinct_count(lines) == len(leaders)


def test_distinct_lines():
    assert similarity.distinct_count(["Xin chào các bạn", "Xin chao các bạn", "tạm biệt", " "]) == 2


def box(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r[:6]), r[6]) for i, r in enumerate(rows)], "video_id long, id long, time double, x double, y double, w double, h double, confidence double, txt string")


def test_text_filter(spark):
    still = [(0.5 * k, 0.18, 0.68, 0.64, 0.05, 0.92, f"第{k}句字幕内容") for k in range(8)]
    moving = [(0.5 * k, 0.1 + 0.06 * k, 0.2 + 0.03 * k, 0.1, 0.04, 0.63, "2ama") for k in range(6)]
    m = boxes.scored(boxes.track_measures(boxes.tracked(box(spark, still + moving))).where(boxes.gate())).where(F.col("score") > boxes.SCORE).collect()
    assert len(m) == 1 and m[0]["n"] == 8 and round(m[0]["x"], 2) == 0.18


REGION = "video_id long, x double, y double, w double, h double, start_s double, end_s double, score double, reasons array<string>"


def regions(spark, rows):
    return spark.createDataFrame([(1, *map(float, r), ["a"]) for r in rows], REGION)


def test_mask_timeline(spark):
    base = (0.2, 0.8, 0.6, 0.05, 2, 4, 3.5)
    got = boxes.mask_timeline(regions(spark, [base])).collect()
    assert len(got) == 1 and got[0]["x"] < 0.2 and got[0]["y"] < 0.8 and got[0]["start_s"] == 1.75 and got[0]["end_s"] == 4.25
    assert len(boxes.mask_timeline(regions(spark, [base, (*base[:4], 4.5, 6, 3.0)])).collect()) == 1
    assert len(boxes.mask_timeline(regions(spark, [base, (0.2, 0.1, 0.6, 0.05, 2, 4, 3.5)])).collect()) == 2
    assert boxes.mask_timeline(regions(spark, [(0.0, 0.0, 1.0, 0.5, 2, 4, 3.5)])).count() == 0
    assert boxes.mask_timeline(regions(spark, [(0.2, 0.8, 0.6, 0.05, 0, 1, 3.5)])).first()["start_s"] == 0.0


def test_touching_is_transitive_and_strict(spark):
    rows = box(spark, [(0, 0, 0, 0.2, 0.2, 1, ""), (0, 0.1, 0.1, 0.2, 0.2, 1, ""), (0, 0.25, 0.25, 0.2, 0.2, 1, ""), (0, 0.45, 0.25, 0.2, 0.2, 1, "")])
    got = {r["id"]: r["component"] for r in boxes.touching(rows, "video_id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


@pytest.mark.parametrize(
    ("url", "platform", "found", "provisional"),
    [
        ("https://www.douyin.com/video/7312345678901234567", "douyin", "7312345678901234567", False),
        ("https://v.douyin.com/iRxAbCd/", "douyin", "iRxAbCd", True),
        ("https://www.bilibili.com/video/BV1xx411c7mD", "bilibili", "BV1xx411c7mD", False),
        ("https://www.youtube.com/watch?v=aqz-KE-bpKQ", "youtube", "aqz-KE-bpKQ", False),
        ("https://youtu.be/aqz-KE-bpKQ", "youtube", "aqz-KE-bpKQ", False),
        ("https://www.tiktok.com/@user.name/video/7123456789012345678", "tiktok", "7123456789012345678", False),
        ("https://x.com/someone/status/1234567890123456789", "twitter", "1234567890123456789", False),
        ("https://vm.tiktok.com/ZSabcdef/", "tiktok", "ZSabcdef", True),
        ("https://b23.tv/aBcD12", "bilibili", "aBcD12", True),
    ],
)
def test_source_url(spark, url, platform, found, provisional):
    s = one(spark, urls.source(F.col("u")), u=url)
    assert (s["platform"], s["id"], s["provisional"]) == (platform, found, provisional)


def test_source_url_boundaries(spark):
    s = lambda u: one(spark, urls.source(F.col("u")), u=u)
    assert s("https://notdouyin.com/video/1")["platform"] == "other"
    assert s("https://netflix.com/x")["platform"] == "other"
    assert s("ftp://x.com/a") is None and s("  ") is None
    assert s("https://www.douyin.com/jingxuan/vlog?modal_id=731")["url"] == "https://www.douyin.com/video/731"
    assert s("https://m.weibo.com/u/9")["platform"] == "weibo"


def test_model_names(spark):
    p = lambda n, o=None: one(spark, models.purpose(F.col("n"), None if o is None else F.array(*map(F.lit, o))), n=n)
    assert p("models/gemini-2.5-flash-tts") == "tts"
    assert p("google/gemini-3-flash") == "translate"
    assert p("openai/gpt-audio", ["text", "audio"]) == "tts"
    assert p("google/lyria-3", ["audio"]) == "other"
    assert p("aion-labs/aion-2.0") == "other" and p("aion-labs/aion-2.0", ["text"]) == "translate"
    assert one(spark, models.cannot_translate(F.col("n")), n="openai/gpt-audio") is True


def test_limits_validation(spark):
    df = spark.createDataFrame(list(LIMITS), LIMITS_SCHEMA)
    assert all(r[0] == [] for r in df.select(states.limit_violations()).collect())
    bad = df.limit(1).withColumns({"title_len": F.lit(0), "max_sec": F.lit(-1), "sa_top": F.lit(0.45), "sa_bottom": F.lit(0.45)})
    assert bad.select(states.limit_violations()).first()[0] == ["title_len", "max_sec", "vertical"]


def test_upsert_and_edits(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, v string, edited boolean")
    new = spark.createDataFrame([(1, "x", False), (2, "y", False), (3, "z", False)], "id int, v string, edited boolean")
    got = {r["id"]: r["v"] for r in library.upserted(old, new, ["id"], F.col("edited")).collect()}
    assert got == {1: "a", 2: "y", 3: "z"}
    c = cues(spark, [(0, 1, "a")])
    blank = spark.createDataFrame([(1, 0, " ")], "video_id long, i long, new_txt string")
    with pytest.raises(Exception, match="no such cue"):
        states.patched(c, blank).collect()


def test_texts(spark):
    assert one(spark, subtitles.srt_stamp(F.col("s")), s=3661.5) == "01:01:01,500"
    assert one(spark, subtitles.srt_stamp(F.col("s")), s=-1.0) == "00:00:00,000"
    assert one(spark, subtitles.ass_stamp(F.col("s")), s=59.999) == "0:01:00.00"
    assert one(spark, subtitles.ass_escaped(F.col("t")), t="{a}\r\nb") == "(a)\\Nb"
    assert one(spark, formats.progress(F.col("t"), F.lit(15.0)), t="out_time_ms=7500000") == 50
    assert one(spark, formats.progress(F.col("t"), F.lit(15.0)), t="frame=1") is None
    assert one(spark, formats.tokens(F.col("n")), n=2_100_000) == "2,1M"
    assert one(spark, formats.duration(F.col("n")), n=61.0) == "1:01"
    assert one(spark, formats.filter_escaped(F.col("t")), t="a:b'c,") == "a\\\\:b\\\\\\'c\\,"
    assert one(spark, audio.warnings(F.lit(3.0), F.lit(0.01), F.lit(1.0), F.lit(0.5)), x=1) == ["too_short", "clipped", "too_quiet", "too_silent"]
    assert layout.fitted("Xem hết nhé", 900, 200)[0] == "Xem hết nhé"
    assert layout.fitted("", 900, 200) == ("", 120)


def test_kernels(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.5, 0.0, 0.2, 0.0, 0.0])], "id int, x array<double>")
    assert df.select(kernels.silent_tail(F.col("x"))).first()[0] == 2
    assert df.select(kernels.trimmed(F.col("x"))).first()[0] == [0.5, 0.0, 0.2, 0.0, 0.0]


def test_topics(spark):
    t = lambda c: one(spark, progress.topic_of(F.col("c")), c=c)
    assert t("media:progress:7") == "video:7" and t("media:status:") is None and t("media:alert") == "alert" and t("x") is None


def test_stream_of_messages(spark, tmp_path):
    rows = [("media:status:7", '{"status":"ready"}', datetime.datetime(2024, 1, 1, 0, 1)), ("media:status:7", '{"status":"running"}', datetime.datetime(2024, 1, 1)), ("media:alert", "{}", datetime.datetime(2024, 1, 1)), ("zzz", "{", datetime.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, progress.SCHEMA).write.parquet(str(tmp_path / "m"))
    stream = progress.messages(spark, str(tmp_path / "m"))
    q = progress.latest_status(stream).writeStream.format("memory").queryName("t_latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    latest = spark.table("t_latest").collect()
    assert [(r["topic"], r["status"]) for r in latest] == [("video:7", "ready")]
    subs = spark.createDataFrame([("c1", "video:7"), ("c2", "queue")], "client string, topic string")
    sent = progress.drained(progress.delivered(stream, subs)).groupBy("client", "topic").count().collect()
    assert {(r[0], r[1], r[2]) for r in sent} == {("c1", "video:7", 2), ("c1", "alert", 1), ("c2", "alert", 1)}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    put = lambda rows: spark.createDataFrame(rows, progress.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    put([("media:status:7", '{"status":"ready"}', at)])
    stream = progress.messages(spark, str(tmp_path / "m"))
    assert progress.drained(stream, str(tmp_path / "out")).count() == 1
    put([("media:status:8", '{"status":"ready"}', at)])
    assert progress.drained(stream, str(tmp_path / "out")).count() == 2  # the first is not read again


@pytest.mark.parametrize("streaming", [False, True])
def test_a_lock_lives_two_hours(spark, tmp_path, streaming):
    at = datetime.datetime(2024, 1, 1)
    rows = [(f"k{k}", "{}", at + datetime.timedelta(seconds=s)) for k in (1, 2) for s in (0, 60, 7199)]
    if not streaming:
        rows += [("k1", "{}", at + datetime.timedelta(seconds=s)) for s in (7200, 14399, 14400)]
        got = progress.deduplicated(spark.createDataFrame(rows, progress.SCHEMA), ["channel"]).collect()
        assert sorted((r["channel"], (r["ingest_ts"] - at).total_seconds()) for r in got) == [("k1", 0), ("k1", 7200), ("k1", 14400), ("k2", 0)]
        return
    put = lambda rows: spark.createDataFrame(rows, progress.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    put(rows)
    stream = progress.deduplicated(progress.messages(spark, str(tmp_path / "m")), ["channel"])
    assert progress.drained(stream, str(tmp_path / "out")).count() == 2
    put([("k3", "{}", at + datetime.timedelta(seconds=30000))])  # moves the watermark past the locks
    progress.drained(stream, str(tmp_path / "out"))
    put([("k1", "{}", at + datetime.timedelta(seconds=30001))])
    assert progress.drained(stream, str(tmp_path / "out")).where("channel = 'k1'").count() == 2


def test_file_md5(spark, tmp_path):
    import hashlib

    (tmp_path / "in" / "deep").mkdir(parents=True)
    files = {"a.bin": b"x" * 3_000_000, "deep/b.txt": b"y"}
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    got = {r["name"]: (r["md5"], r["size"]) for r in progress.file_md5(spark, str(tmp_path / "in")).collect()}
    assert got == {n: (hashlib.md5(c).hexdigest(), len(c)) for n, c in files.items()}


def test_file_md5_of_a_file_beyond_the_readers_largest_row(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b%20.bin").write_bytes(content := b"xyz" * 1_000_000)
    key = "spark.sql.sources.binaryFile.maxLength"  # 2 GB, less in this test
    before = spark.conf.get(key)
    spark.conf.set(key, "1000000")
    try:
        got = [tuple(r) for r in progress.file_md5(spark, str(tmp_path / "in")).collect()]
    finally:
        spark.conf.set(key, before)
    assert got == [("a b%20.bin", hashlib.md5(content).hexdigest(), len(content))]
