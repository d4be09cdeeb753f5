"""Duplicates among videos: exact, perceptual, and which of them is the original."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.functions.hashing import signed, words_of_hex
from lumora.operators.order import checkpointed, latest_before, placed, running


def oldest_same(videos: DataFrame, key: str = "md5") -> DataFrame:
    """``videos`` with ``original``: the id of the oldest other one of the same ``key`` that is not skipped itself.

    One aggregate of the two oldest per key, joined back, so a key that many share costs no pairs.
    """
    order = F.struct("created_at", "id")
    kept = F.when((F.col("status") != "skipped") & F.col(key).isNotNull(), F.struct("created_at", "id"))
    least = videos.where(kept.isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r <= 2")
    firsts = least.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct("_r", "id")).alias("_1"), F.max(F.when(F.col("_r") == 2, F.col("id"))).alias("_2"))
    own = videos.join(firsts, videos[key] == firsts["_k"], "left")
    return own.withColumn("original", F.when(F.col("_1.id") != F.col("id"), F.col("_1.id")).otherwise(F.col("_2"))).drop("_k", "_1", "_2")


class Segment(NamedTuple):
    """``width`` bits of a hash's word, ``offset`` bits above its lowest, looked up within ``radius`` differing bits."""

    word: int
    offset: int
    width: int
    radius: int


def segments_for(words: int, distance: int) -> list[Segment]:
    """Disjoint segments of ``words`` 64-bit words such that hashes within ``distance`` bits are within the radius in at
    least one: the radii plus one add up to distance + 1. Radii are 0 or 1, so a lookup asks width + 1 keys at most."""
    n = max(1, -(-(distance + 1) // 2))
    if distance < 0 or n > 64 * words:
        raise ValueError("a distance between 0 and the hash's bits")
    out: list[Segment] = []
    for w in range(words):
        own = n // words + (w < n % words)
        edges = [64 * k // own for k in range(own + 1)] if own else []
        out += [Segment(w, lo, hi - lo, int(len(out) + k <= distance - n)) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return out


def _hashes(rows: DataFrame, id_name: str, length: int, stride: int) -> DataFrame:
    """(id, words) of the valid hashes of ``length`` hex digits; leading zeros fill the first word.

    Digits are dealt out anew, every ``stride``-th after the other, in all hashes alike: that changes no distance, and a
    stretch of digits that many hashes share (a blank end) falls to all segments a little and to none as a whole.
    """
    good = (F.length("phash") == length) & F.col("phash").rlike("^[0-9a-fA-F]+$")
    n = -(-length // 16)
    dealt = sorted(range(16 * n), key=lambda k: (k % stride, k))
    digits = F.lpad("phash", 16 * n, "0")
    return rows.where(good).select(F.col("id").alias(id_name), words_of_hex(F.concat(*[F.substr(digits, F.lit(k + 1), F.lit(1)) for k in dealt]), n).alias("words"))


def similar_pairs(probes: DataFrame, candidates: DataFrame, distance: int, length: int, broadcast_candidates: bool = False) -> DataFrame:
    """(id, other, distance) of hashes (id, phash, hex digits of ``length``) that differ in at most ``distance`` bits.

    Multi-index hashing: candidates are filed under the values of disjoint segments of their bits, and a probe looks up
    its own values and those one bit away. A pair that meets in several segments counts in the first, so no distinct is
    needed. Exact for any distance; it selects well while segments (64 words bits over (distance + 1) / 2) have as many
    bits as the number of hashes has. Hashes that many rows share should be reduced first (``hash_classes``). Null,
    empty, ill-formed hashes and those of another length match nothing. ``broadcast_candidates`` is for a bounded side.
    """
    cuts = segments_for(-(-length // 16), distance)

    def value(words: str, s: Segment) -> Column:
        return F.shiftrightunsigned(F.get(F.col(words), F.lit(s.word)), s.offset).bitwiseAND(F.lit(signed((1 << s.width) - 1)).cast("long"))

    def parts(words: str) -> Column:
        """One (segment, key, bits that a look-up flips) for each segment."""
        return F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), value(words, s).alias("key"), F.lit(s.width * s.radius).alias("bits")) for k, s in enumerate(cuts)]))

    a, b = _hashes(probes, "id", length, len(cuts)), _hashes(candidates, "other", length, len(cuts))
    asked = a.select("id", F.col("words").alias("wa"), parts("words").alias("k")).select("id", "wa", "k.*", F.explode(F.sequence(F.lit(-1), F.col("k.bits") - 1)).alias("flip"))
    asked = asked.select("id", "wa", "seg", F.expr("CASE WHEN flip < 0 THEN key ELSE key ^ shiftleft(1L, flip) END").alias("key")).alias("a")
    filed = b.select("other", F.col("words").alias("wb"), parts("words").alias("k")).select("other", "wb", F.col("k.seg").alias("seg_b"), F.col("k.key").alias("key_b"))
    d = reduce(Column.__add__, [F.bit_count(F.get("wa", F.lit(w)).bitwiseXOR(F.get("wb", F.lit(w)))) for w in range(-(-length // 16))])
    first = F.coalesce(*[F.when(F.bit_count(value("wa", s).bitwiseXOR(value("wb", s))) <= s.radius, F.lit(k)) for k, s in enumerate(cuts)])
    met = (F.col("seg") == F.col("seg_b")) & (F.col("key") == F.col("key_b")) & (F.col("id") != F.col("other")) & (d <= distance)
    # Spark takes what is exploded for as small as its hashes, and would broadcast the look-ups
    pairs = asked.join(F.broadcast(filed), met) if broadcast_candidates else asked.hint("merge").join(filed.hint("merge"), met)
    return pairs.where(F.col("seg") == first).select("id", "other", d.cast("int").alias("distance"))


def hash_classes(rows: DataFrame) -> DataFrame:
    """(phash, id, copies): the smallest id of each hash that is not null, and how many rows have it."""
    return rows.where("phash IS NOT NULL").groupBy("phash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


#: A video's state while arrivals are judged: not known yet, an original, a copy.
OPEN, ORIGINAL, COPY = 0, 1, 2
#: Questions of open videos that one task settles in turn; more of them are settled in rounds first.
REPLAY = 1 << 17


def _settled(window: int):
    """Settles the open videos of all batches in their order: each asks for the last original of its classes, the one known before
    or a newer one of these videos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["pos"])
        newest: dict[tuple[str, str], dict] = {}
        copied: list[int] = []  # places of the hashed ones that became copies
        now: dict[int, int] = {}
        for id_, asked in groupby(rows, key=lambda r: r["id"]):
            asked = list(asked)
            v, state = asked[0], ORIGINAL
            for q in asked:
                last = max((x for x in (q["original"], newest.get((q["kind"], q["key"]))) if x), key=lambda x: x["pos"], default=None)
                if last and q["kind"] == "phash":
                    copies = v["copies"] - last["copies"] + len(copied) - bisect_right(copied, last["pos"])
                    last = last if v["before"] - last["before"] - 1 - copies < window else None
                if last:
                    state = COPY
            now[id_] = state
            if state == COPY and v["hashed"]:
                copied.append(v["pos"])
            elif state == ORIGINAL and v["counts"]:
                newest["md5", v["md5"]] = newest["phash", v["phash"]] = v
        yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.int64()), pa.array(list(now.values()), pa.int32())], ["_id", "_now"])

    return run


def originals(videos: DataFrame, window: int = 500, distance: int = 20, length: int = 64) -> DataFrame:
    """(id, original, reason) of all ``videos`` (id, created_at, md5, phash, status), each judged when it arrives.

    A video is a copy (reason md5) of the oldest earlier original with its md5, else (phash) of the most recent earlier original
    within ``distance`` bits among the ``window`` newest that have a hash; otherwise it is an original itself. Copies and
    videos whose status is skipped already are no originals, so no copy points to a copy, and they take no place in
    the window. Videos arrive in the order of created_at, then id; null and ill-formed hashes match nothing.

    That order is greedy, so it is settled in rounds, each from a checkpoint, until no more than REPLAY questions are open, which
    one task settles in turn (``_settled``). In a round a video becomes a copy once an earlier original is
    surely within its window, and an original once no earlier one that is still open, or that may be within the
    window, is left. How many originals lie between two videos is a difference of running counts, known up to the
    open ones. The first open video can always be settled. Rounds are as many as the longest chain of
    videos that hang on each other, mostly below ten. Videos that share no hash and are near no other never enter them.
    Equal hashes are one class: a video asks each class near its own for its last original before the video's place
    (``latest_before``), so a class that a third of all videos share costs no pairs and is no single task.
    """
    whole = (F.length("phash") == length) & F.col("phash").rlike("^[0-9a-fA-F]+$")
    rows = videos.select("id", "created_at", "md5", F.when(whole, F.lower("phash")).alias("phash"), (F.coalesce("status", F.lit("")) != "skipped").alias("counts"))
    rows = rows.withColumn("hashed", F.col("counts") & F.col("phash").isNotNull())
    rows = checkpointed(placed(rows, ["created_at", "id"], F.col("hashed")))
    classes = hash_classes(rows)
    pairs = similar_pairs(classes, classes, distance, length)
    of = classes.select(F.col("id").alias("_i"), F.col("phash").alias("_h"))
    near = checkpointed(pairs.join(of, F.col("other") == F.col("_i")).select("id", F.col("_h").alias("key")))
    own = classes.where("copies > 1").select("id", F.col("phash").alias("key"))
    near = checkpointed(classes.select("id", "phash").join(near.unionByName(own), "id").select(F.col("phash").alias("_h"), "key"))
    shared = rows.where("md5 IS NOT NULL").groupBy(F.col("md5").alias("_m")).agg(F.count("*").alias("_n")).where("_n > 1").select("_m")
    told = ["id", "pos", "before", "counts", "hashed", "md5", "phash"]
    exact = rows.join(shared, F.col("md5") == F.col("_m"), "left_semi").select(*told, F.lit("md5").alias("kind"), F.col("md5").alias("key"))
    asks = exact.unionByName(rows.join(near, F.col("phash") == F.col("_h")).select(*told, F.lit("phash").alias("kind"), "key"))
    asks = checkpointed(asks)
    ends = near.select("_h").distinct()
    filed = exact.unionByName(rows.join(ends, F.col("phash") == F.col("_h"), "left_semi").select(*told, F.lit("phash").alias("kind"), F.col("phash").alias("key")))
    filed = checkpointed(filed.where("counts").drop("counts", "hashed", "md5", "phash"))
    state = checkpointed(asks.select(*told).distinct().withColumn("state", F.lit(OPEN)))

    def seen(state: DataFrame, which: Column) -> DataFrame:
        """The asks of the videos ``which`` holds for, with the last original and the last open one of the class asked, and how many
        videos with a hash surely (``_least``) and at most (``_most``) lie between."""
        known = running(state, "pos", {c: (F.col("hashed") & (F.col("state") == x)).cast("int") for c, x in (("copies", COPY), ("opens", OPEN))})
        known = checkpointed(known).select(F.col("id").alias("_id"), "state", "copies", "opens")
        who = asks.join(known, F.col("id") == F.col("_id")).where(which).drop("_id")
        there = filed.join(known, F.col("id") == F.col("_id")).where(F.col("state") != COPY)
        place = F.struct("pos", "id", "before", "copies", "opens")
        return latest_before(who, there, ["kind", "key"], "pos", {"original": F.when(F.col("state") == ORIGINAL, place), "opened": F.when(F.col("state") == OPEN, place)})

    def most(c: str) -> Column:
        return F.col("before") - F.col(f"{c}.before") - 1 - (F.col("copies") - F.col(f"{c}.copies"))

    def least(c: str) -> Column:
        return most(c) - (F.col("opens") - F.col(f"{c}.opens"))

    exactly = F.col("kind") == "md5"
    surely = F.col("original").isNotNull() & (exactly | (most("original") < window))
    perhaps = F.col("original").isNotNull() & ~exactly & (least("original") < window) & (most("original") >= window)
    waits = perhaps | (F.col("opened").isNotNull() & (exactly | (least("opened") < window)))
    while asks.join(state.where(F.col("state") == OPEN).select("id"), "id", "left_semi").limit(REPLAY + 1).count() > REPLAY:
        told_now = seen(state, F.col("state") == OPEN).groupBy(F.col("id").alias("_id")).agg(F.max(F.coalesce(surely, F.lit(False))).alias("_copy"), F.max(F.coalesce(waits, F.lit(False))).alias("_wait"))
        now = F.when(F.col("_copy"), COPY).when(F.col("_wait").isNull(), F.col("state")).when(~F.col("_wait"), ORIGINAL).otherwise(F.col("state"))
        state = checkpointed(state.join(told_now, F.col("id") == F.col("_id"), "left").select(*told, now.alias("state")))
    last = seen(state, F.col("state") == OPEN).drop("opened").coalesce(1).mapInArrow(_settled(window), "_id long, _now int")
    state = checkpointed(state.join(last, F.col("id") == F.col("_id"), "left").select(*told, F.coalesce("_now", "state").alias("state")))
    oldest = filed.where("kind = 'md5'").join(state.where(F.col("state") == ORIGINAL).select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")
    oldest = oldest.groupBy(F.col("key").alias("_m")).agg(F.min(F.struct("pos", "id")).alias("_o"))
    same = rows.join(oldest, (F.col("md5") == F.col("_m")) & (F.col("_o.pos") < F.col("pos"))).select(F.col("id").alias("_s"), F.col("_o.id").alias("same"))
    alike = seen(state, F.col("state") == COPY).where(~exactly & surely).groupBy(F.col("id").alias("_n")).agg(F.max(F.struct("original.pos", "original.id")).alias("_l"))
    out = rows.select("id").join(same, F.col("id") == F.col("_s"), "left").join(alike, F.col("id") == F.col("_n"), "left")
    reason = F.when(F.col("same").isNotNull(), "md5").when(F.col("_l").isNotNull(), "phash")
    return out.select("id", F.coalesce("same", "_l.id").alias("original"), reason.alias("reason"))


#: Buckets of characters by which the share that two lines can match is bounded.
BUCKETS = 64


def distinct_count(lines: list[str], same: float = 0.75) -> int:
    """Number of different lines, those within ``same`` of an earlier leader by matching blocks aside; blank ones too.

    The first line left leads, and all within reach of it leave with it. What two lines match is at most what their
    characters have in common; that bound, from counts in BUCKETS, is computed for all lines left at once, and
    only lines that it lets through are matched.
    """
    texts = [x for x in dict.fromkeys(" ".join(x.split()) for x in lines) if x]
    counts = np.array([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS) for x in texts], np.int32).reshape(-1, BUCKETS)
    sizes, left, n, m = counts.sum(1), np.arange(len(texts)), 0, SequenceMatcher()
    while len(left):
        lead, left, n = left[0], left[1:], n + 1
        near = 2 * np.minimum(counts[left], counts[lead]).sum(1) >= same * (sizes[left] + sizes[lead]) - 1e-9
        m.set_seq2(texts[lead])
        for k in np.flatnonzero(near):
            m.set_seq1(texts[left[k]])
            near[k] = m.quick_ratio() >= same and m.ratio() >= same
        left = left[~near]
    return n


@F.pandas_udf(T.IntegerType())
def distinct_lines(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``distinct_count`` of arrays of strings."""
    for batch in lines:
        yield batch.map(lambda x: distinct_count([s for s in x if s is not None]) if x is not None else None)


def recomputed(rows: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(id, key, reused) in order of (key, place): whether a frame's crop differs by less than ``threshold`` on average
    from the last one that was computed anew. ``rows``: (key, place, id, pixels). The comparison follows its own
    decisions, so it is a fold over each key's frames: one frame at a time is compared with all after it, up to the
    first that differs. A crop of another size is computed anew."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["place", "id"])
        sizes = b["pixels"].map(len).to_numpy()
        reused = np.ones(len(b), bool)
        for span in np.split(np.arange(len(b)), np.flatnonzero(np.diff(sizes)) + 1):
            pixels = np.stack(b["pixels"].iloc[span].to_numpy()).astype(float)
            at = 0
            while at < len(span):
                reused[span[at]] = False
                step = 64
                while at < len(span):  # look ahead in growing blocks
                    ahead = np.abs(pixels[at + 1 : at + 1 + step] - pixels[at]).mean(1) >= threshold
                    if ahead.any() or at + 1 + step >= len(span):
                        at = at + 1 + int(ahead.argmax()) if ahead.any() else len(span)
                        break
                    step *= 4
        return pd.DataFrame({"id": b["id"], "key": b["key"], "reused": reused})

    return rows.groupBy("key").applyInPandas(run, "id long, key long, reused boolean")
