"""Boxes in space and time: overlap, tracks of text, masks and their merging. Coordinates are shares of the frame."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators.graphs import components
from lumora.operators.order import checkpointed
from lumora.operators.similarity import distinct_lines

#: Fixed values of the text filter: least confidence, overlap within a track, tallest track, least boxes, least Han share,
#: lines that prove change, score to exceed; weights and middle band of the score.
LEAST_CONFIDENCE, SAME_TRACK, TALLEST_TRACK, LEAST_BOXES, LEAST_HAN, ENOUGH_LINES, SCORE = 0.45, 0.45, 1.8, 2, 0.3, 3, 2.0
W_STEADY, W_CHANGE, W_CONFIDENCE, W_BAND, W_HAN, STEADY_BOXES, BAND = 1.6, 1.2, 0.6, 0.5, 1.0, 4, (0.25, 0.92)
#: Fixed values of the masks: margins, widening in time, bridging, merging, caps.
MARGIN, MARGIN_OF_HEIGHT, WIDEN_S, SAME_PLACE, BRIDGE_S, BRIDGE_HEIGHT = 0.006, 0.35, 0.25, 0.5, 1.5, 1.6
SAME_TIME, TALLEST, LARGEST, MERGE_GROWTH = 0.8, 0.14, 0.20, 1.8


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 where they only touch."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    common = w * h
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(common / (a["w"] * a["h"] + b["w"] * b["h"] - common))


def quad_box(points: Column, width: Column, height: Column) -> Column:
    """struct<x, y, w, h> around an array of points (x, y) in pixels, in shares within the frame; fewer than four points
    or an empty frame raise."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    lo_x, hi_x = unit(F.array_min(xs) / width), unit(F.array_max(xs) / width)
    lo_y, hi_y = unit(F.array_min(ys) / height), unit(F.array_max(ys) / height)
    box = F.struct(lo_x.alias("x"), lo_y.alias("y"), (hi_x - lo_x).alias("w"), (hi_y - lo_y).alias("h"))
    return F.when((F.size(points) >= 4) & (width > 0) & (height > 0), box).otherwise(F.raise_error(F.lit("not a box")).cast("struct<x:double,y:double,w:double,h:double>"))


def han_share(text: Column) -> Column:
    """Share of Han characters among those that are not white space; 0 for none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")
    return F.when(bare == "", F.lit(0.0)).otherwise(F.length(F.regexp_replace(bare, "[^一-鿿㐀-䶿]", "")) / F.length(bare))


class Box(NamedTuple):
    left: float
    top: float
    right: float
    bottom: float

    @property
    def area(self) -> float:
        return (self.right - self.left) * (self.bottom - self.top)

    def common(self, o: Box) -> float:
        wide, high = min(self.right, o.right) - max(self.left, o.left), min(self.bottom, o.bottom) - max(self.top, o.top)
        return wide * high if wide > 0 and high > 0 else 0.0

    def likeness(self, o: Box) -> float:
        shared = self.common(o)
        return shared / (self.area + o.area - shared) if shared else 0.0

    def around(self, o: Box) -> Box:
        return Box(min(self.left, o.left), min(self.top, o.top), max(self.right, o.right), max(self.bottom, o.bottom))


def boxes_of(x: list, y: list, w: list, h: list) -> list[Box]:
    return [Box(a, b, a + c, b + d) for a, b, c, d in zip(x, y, w, h)]


#: Side of the squares of the frame by which open tracks are found.
CELL = 0.1


def track_numbers(boxes: list[Box]) -> list[int]:
    """The track of each box, boxes being in order: the first one whose last box is alike enough and whose height stays
    within its first box's share, else a new one. Only tracks with a last box in the same part of the frame are asked."""
    here: dict[tuple[int, int], set[int]] = defaultdict(set)
    last, tall, span, out = [], [], [], []

    def cells(b: Box) -> list[tuple[int, int]]:
        return [(i, j) for i in range(int(b.left / CELL), int(b.right / CELL) + 1) for j in range(int(b.top / CELL), int(b.bottom / CELL) + 1)]

    for b in boxes:
        own = cells(b)
        fits = [t for t in set().union(*(here[c] for c in own)) if last[t].likeness(b) >= SAME_TRACK and max(span[t][1], b.bottom) - min(span[t][0], b.top) <= tall[t]]
        t = min(fits, default=len(last))
        if t == len(last):
            last.append(b)
            tall.append((b.bottom - b.top) * TALLEST_TRACK)
            span.append((b.top, b.bottom))
        else:
            for c in cells(last[t]):
                here[c].discard(t)
            last[t], span[t] = b, (min(span[t][0], b.top), max(span[t][1], b.bottom))
        for c in own:
            here[c].add(t)
        out.append(t)
    return out


def _numbered(boxes: DataFrame, key: str, order: list[str], name: str, number: Callable[[list[Box]], list[int]]) -> DataFrame:
    """``boxes`` with ``name``: what ``number`` says of each box of a key, the boxes being in ``order``. A key's rows are
    one array, so one call serves many short videos."""
    cols = [*order, *[c for c in boxes.columns if c not in order]]

    @F.pandas_udf("array<long>")
    def numbers(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.array(number(boxes_of(*(c.tolist() for c in r))), np.int64) for r in zip(x, y, w, h)])

    rows = boxes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_rows"))
    rows = rows.select("_rows", numbers(*[F.col(f"_rows.{c}") for c in ("x", "y", "w", "h")]).alias("_n"))
    rows = rows.select(F.explode(F.arrays_zip("_rows", "_n")).alias("_z"))
    return rows.select(*[F.col(f"_z._rows.{c}").alias(c) for c in boxes.columns], F.col("_z._n").alias(name))


def tracked(boxes: DataFrame, key: str = "video_id") -> DataFrame:
    """Adds ``track`` to ``boxes`` (key, id, time, x, y, w, h): in the order of time, y and x, a box joins the first track
    whose last box overlaps it enough and which it leaves low enough; else it starts one. Greedy in order, so each
    video is one group; rows of low confidence go before."""
    return _numbered(boxes, key, ["time", "y", "x", "id"], "track", track_numbers)


def track_measures(tracks: DataFrame, key: str = "video_id") -> DataFrame:
    """One row per track: its box, times, number of boxes, mean confidence, highest Han share, different lines."""
    edge = lambda a, b: F.max(F.col(a) + F.col(b))
    m = tracks.groupBy(key, "track").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), edge("x", "w").alias("_r"), edge("y", "h").alias("_b"), F.min("time").alias("start_s"), F.max("time").alias("end_s"),
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.max(han_share(F.col("txt"))).alias("han"),
        F.array_sort(F.collect_list(F.struct("time", "y", "x", "txt"))).alias("_t"),
    )
    m = m.withColumn("w", F.col("_r") - F.col("x")).withColumn("h", F.col("_b") - F.col("y"))
    return m.withColumn("lines", distinct_lines(F.transform("_t", lambda t: t["txt"]))).drop("_r", "_b", "_t")


def scored(m: DataFrame) -> DataFrame:
    """Adds ``score`` and ``reasons`` to track measures."""
    n, k = F.col("n"), F.col("lines")
    steady = F.least(F.lit(1.0), n / STEADY_BOXES)
    change = F.when((n > 1) & (k > 1), (k - 1) / (n - 1)).otherwise(F.lit(0.0))
    sure = unit((F.col("confidence") - LEAST_CONFIDENCE) / (1 - LEAST_CONFIDENCE))
    band = (F.col("y") + F.col("h") / 2).between(*BAND)
    score = W_STEADY * steady + W_CHANGE * change + W_CONFIDENCE * sure + F.when(band, F.lit(W_BAND)).otherwise(F.lit(0.0)) + W_HAN * F.col("han")
    reasons = F.array_compact(F.array(F.lit("steady"), F.when(change > 0, "changes"), F.lit("confidence"), F.when(band, "middle"), F.when(F.col("han") > 0, "han")))
    return m.withColumn("score", score).withColumn("reasons", reasons)


def gate() -> Column:
    """Enough boxes, and Han text or enough different lines."""
    return (F.col("n") >= LEAST_BOXES) & ((F.col("han") >= LEAST_HAN) | (F.col("lines") >= ENOUGH_LINES))


def dilated(regions: DataFrame) -> DataFrame:
    """Regions widened by their margin within the frame and in time, not before 0."""
    pad = F.greatest(F.lit(MARGIN), F.col("h") * MARGIN_OF_HEIGHT)
    rows = regions.withColumns({
        "_l": unit(F.col("x") - pad), "_t": unit(F.col("y") - pad), "_r": unit(F.col("x") + F.col("w") + pad), "_b": unit(F.col("y") + F.col("h") + pad),
    })
    return rows.withColumns({
        "x": F.col("_l"), "y": F.col("_t"), "w": F.col("_r") - F.col("_l"), "h": F.col("_b") - F.col("_t"),
        "start_s": F.greatest(F.lit(0.0), F.col("start_s") - WIDEN_S), "end_s": F.col("end_s") + WIDEN_S,
    }).drop("_l", "_t", "_r", "_b")


class Region(NamedTuple):
    box: Box
    start: float
    end: float
    score: float
    reasons: tuple[str, ...]

    def with_(self, o: Region) -> Region:
        """The box and time around both, the higher score, reasons of both once each in order."""
        return Region(self.box.around(o.box), min(self.start, o.start), max(self.end, o.end), max(self.score, o.score), tuple(dict.fromkeys(self.reasons + o.reasons)))

    @property
    def high(self) -> float:
        return self.box.bottom - self.box.top


def bridge(regions: list[Region]) -> list[Region]:
    """In order of start, each region joins the first kept one in its place that ended at most BRIDGE_S before, unless
    that grows beyond its first height's share or the cap. Starts only grow, so what ended too long ago is done with."""
    kept: list[Region] = []
    most: list[float] = []
    open_: list[int] = []
    for r in sorted(regions, key=lambda r: r.start):
        open_ = [k for k in open_ if r.start - kept[k].end <= BRIDGE_S]
        k = next((k for k in open_ if kept[k].box.likeness(r.box) >= SAME_PLACE and kept[k].with_(r).high <= most[k]), None)
        if k is None:
            open_.append(len(kept))
            most.append(min(r.high * BRIDGE_HEIGHT, TALLEST))
            kept.append(r)
        else:
            kept[k] = kept[k].with_(r)
    return kept


def mergeable(a: Region, b: Region) -> bool:
    """At one time, overlapping, and within the caps together."""
    longest = max(a.end - a.start, b.end - b.start)
    if longest <= 0 or min(a.end, b.end) - max(a.start, b.start) < SAME_TIME * longest or not a.box.common(b.box):
        return False
    whole = a.box.around(b.box)
    return whole.bottom - whole.top <= TALLEST and whole.area <= min(LARGEST, (a.box.area + b.box.area) * MERGE_GROWTH)


def merge(regions: list[Region]) -> list[Region]:
    """Regions at one time and place joined while the caps allow. Of all pairs that may join, the one earliest in the list
    goes first, and what it makes stands at the list's end.

    Pairs wait in a heap by their places. Regions at one time start within a quarter of either's length of each other,
    so partners are looked up by start.
    """
    all_, alive = list(regions), set(range(len(regions)))
    starts = sorted((r.start, i) for i, r in enumerate(all_))

    def partners(i: int) -> Iterator[int]:
        r = all_[i]
        reach = (r.end - r.start) * (1 / SAME_TIME - 1) + 1e-6
        for k in range(bisect_left(starts, (r.start - reach, -1)), len(starts)):
            if starts[k][0] > r.start + reach:
                break
            j = starts[k][1]
            if j != i and j in alive and mergeable(r, all_[j]):
                yield j

    pairs = [(i, j) for i in alive for j in partners(i) if i < j]
    heapify(pairs)
    while pairs:
        i, j = heappop(pairs)
        if i in alive and j in alive:
            alive -= {i, j}
            n = len(all_)
            all_.append(all_[i].with_(all_[j]))
            insort(starts, (all_[n].start, n))
            alive.add(n)
            for k in partners(n):
                heappush(pairs, (k, n))
    return [all_[i] for i in sorted(alive)]


_FIELDS = ("x", "y", "w", "h", "start_s", "end_s", "score", "reasons")
_REGION = "x double, y double, w double, h double, start_s double, end_s double, score double, reasons array<string>"
#: Regions that a worker turns into objects at a time, unless one video has more.
HELD = 1 << 14


def spans_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of the rows in turn, ``most`` of their ``sizes`` together or one row."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def folded(regions: DataFrame, *folds: Callable[[list[Region]], list[Region]]) -> DataFrame:
    """Each video's regions through the ``folds``, which depend on their own order; start, y, x and score give the order.

    A worker holds the objects of HELD regions, or of one video, whatever its task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, stop in spans_of(pc.list_value_length(whole.column("_r")).to_numpy(), HELD):
                b = whole.slice(at, stop - at)
                ends = np.cumsum(pc.list_value_length(b.column("_r")).to_numpy()).tolist()
                flat = b.column("_r").flatten()
                cols = {f: flat.field(i) for i, f in enumerate(order)}
                x, y, w, h, start, end, score = (cols[f].to_numpy(zero_copy_only=False).tolist() for f in _FIELDS[:-1])
                every = [Region(*v[:4], tuple(v[4])) for v in zip(boxes_of(x, y, w, h), start, end, score, cols["reasons"].to_pylist())]
                rows, counts, lo = [], [], 0
                for hi in ends:
                    own, lo = every[lo:hi], hi
                    for f in folds:
                        own = f(own)
                    rows += own
                    counts.append(len(own))
                ids = b.column("video_id").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                left, top = [v.box.left for v in rows], [v.box.top for v in rows]
                numbers = [left, top, [v.box.right - v.box.left for v in rows], [v.high for v in rows], [v.start for v in rows], [v.end for v in rows], [v.score for v in rows]]
                reasons = pa.array([list(v.reasons) for v in rows], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.float64()) for c in numbers], reasons], ["video_id", *_FIELDS])

    order = ("start_s", "y", "x", "score", "w", "h", "end_s", "reasons")
    number = lambda c: F.col(c) if c == "reasons" else F.col(c).cast("double").alias(c)
    rows = regions.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*[number(c) for c in order]))).alias("_r"))
    return rows.mapInArrow(run, f"video_id {regions.schema['video_id'].dataType.simpleString()}, {_REGION}")


def not_oversize(masks: DataFrame) -> DataFrame:
    return masks.where((F.col("h") <= TALLEST) & (F.col("w") * F.col("h") <= LARGEST))


def mask_timeline(regions: DataFrame) -> DataFrame:
    """Dilate, bridge, merge, drop what is too large: in this order."""
    return not_oversize(folded(dilated(regions), bridge, merge)).orderBy("video_id", "start_s", "y", "x")


def component_roots(boxes: list[Box]) -> list[int]:
    """For each box the place of the first one it is joined to by overlaps.

    A sweep from left to right keeps, for each stretch of heights, the box there that reaches farthest right: all boxes
    there that are still open overlap it. A new box is joined to those of the stretches that it meets, and takes over
    where it reaches farther.
    """
    root = list(range(len(boxes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    stretches: list[tuple[float, float, int]] = []  # (from, to, box), in order
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i].left):
        new = boxes[i]
        if new.right <= new.left or new.bottom <= new.top:
            continue
        first = bisect_left(stretches, new.top, key=lambda s: s[1])
        while first < len(stretches) and stretches[first][1] <= new.top:
            first += 1
        last, inside, at = first, [], new.top
        while last < len(stretches) and stretches[last][0] < new.bottom:
            low, high, j = stretches[last]
            last += 1
            if boxes[j].right <= new.left:
                continue
            a, b = sorted((top(i), top(j)))
            root[b] = a
            if low < new.top:
                inside.append((low, new.top, j))
            if boxes[j].right > new.right:
                low, end = max(low, new.top), min(high, new.bottom)
                inside += [(at, low, i)] * (at < low) + [(low, end, j)]
                at = end
            if high > new.bottom:
                inside += [(at, new.bottom, i)] * (at < new.bottom) + [(new.bottom, high, j)]
                at = new.bottom
        inside += [(at, new.bottom, i)] * (at < new.bottom)
        stretches[first:last] = inside
    return [top(i) for i in range(len(boxes))]


#: Boxes of a key that are swept as one, and the strips that a key with more is cut into.
SWEPT, STRIPS = 20_000, 64


def touching(boxes: DataFrame, key: str) -> DataFrame:
    """Adds ``component``: the smallest id among the boxes of a key that overlap, transitively.

    A key with more than SWEPT boxes is cut into STRIPS strips at quantiles of its boxes' left sides; a box belongs to all
    strips that it meets. Each strip is swept alone (``component_roots``), equal boxes as one, and what boxes
    in several strips join is found by contraction (``graphs.components``). So a dense video is many tasks, and the
    edges are a row for a box and strip.
    """
    shape = ["x", "y", "w", "h"]
    distinct = checkpointed(boxes.groupBy(key, *shape).agg(F.min("id").alias("_first")))
    cuts = F.percentile_approx("x", F.array(*[F.lit(i / STRIPS) for i in range(1, STRIPS)]), 10_000)
    of = distinct.groupBy(F.col(key).alias("_k")).agg(F.when(F.count("*") > SWEPT, F.array_distinct(cuts)).otherwise(F.array().cast("array<double>")).alias("_cuts"))
    begin, end = F.size(F.filter("_cuts", lambda c: c <= F.col("x"))), F.size(F.filter("_cuts", lambda c: c < F.col("x") + F.col("w")))
    cut = distinct.join(of, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_several", F.size("_cuts") > 0)
    cut = cut.withColumn("_strip", F.explode(F.sequence(begin, F.greatest(begin, end)))).drop("_k", "_cuts")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_first")
        roots = component_roots(boxes_of(*(b[c].tolist() for c in shape)))
        return pd.DataFrame({key: b[key], "_id": b["_first"], "_root": b["_first"].to_numpy()[roots], "_several": b["_several"]})

    kind = boxes.schema[key].dataType.simpleString()
    swept = cut.groupBy(key, "_strip").applyInPandas(run, f"{key} {kind}, _id long, _root long, _several boolean")
    swept = checkpointed(swept)
    alone = swept.where("NOT _several").select(F.col(key).alias("_k"), F.col("_id"), F.col("_root").alias("component"))
    if not (several := swept.where("_several")).isEmpty():
        ends = several.select(F.struct(F.col(key).alias("k"), F.col("_id").alias("i")).alias("a"), F.struct(F.col(key).alias("k"), F.col("_root").alias("i")).alias("b"))
        alone = alone.unionByName(components(ends).select(F.col("v.k").alias("_k"), F.col("v.i").alias("_id"), F.col("component.i").alias("component")))
    first = distinct.join(alone, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_first") == F.col("_id"))).select(*[F.col(c).alias(f"_{c}") for c in (key, *shape)], "component")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (key, *shape)]
    return boxes.join(first, same).select(*boxes.columns, "component")


def pixels(boxes: DataFrame, width: int, height: int, margin: int = 12) -> DataFrame:
    """Adds px_left, px_top, px_right, px_bottom: whole pixels with a margin, within the frame, never empty. A frame
    without size raises."""
    if width <= 0 or height <= 0:
        raise ValueError("a frame without size")

    def edges(at: str, size: str, most: int) -> tuple[Column, Column]:
        low = F.greatest(F.lit(0).cast("long"), F.floor(F.col(at) * most) - margin)
        high = F.least(F.lit(most).cast("long"), F.floor((F.col(at) + F.col(size)) * most) + margin)
        wide = F.least(F.lit(most).cast("long"), low + 1)
        return F.when(high > low, low).otherwise(F.greatest(F.lit(0).cast("long"), wide - 1)), F.when(high > low, high).otherwise(wide)

    (left, right), (top, bottom) = edges("x", "w", width), edges("y", "h", height)
    return boxes.withColumns({"px_left": left, "px_top": top, "px_right": right, "px_bottom": bottom})
