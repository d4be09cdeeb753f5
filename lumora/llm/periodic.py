"""Periodic runs of words: a harmonic grid of common-prefix queries on suffix arrays, and texts with their runs collapsed."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import read, sliced

#: A run has at least LEAST words and REPEATS periods.
LEAST, REPEATS = 6, 4
#: Pairs of grid positions that are asked at a time.
PAIRS = 1 << 18

RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>"

Edit = Callable[[int | None, list[bytes]], list[bytes]]


class Suffixes:
    """Suffix array of integers by doubling, and range minima over its common prefixes."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        levels, rank, width, width_of = [np.append(codes, -1)], codes.astype(np.int64), 1, int(codes.max()) + 1
        while True:
            key = rank * (max(width_of, n) + 1)
            key[: max(n - width, 0)] += rank[width:] + 1
            order = np.argsort(key)
            ranked = key[order]
            names = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = names
            width_of = int(names[-1]) + 1
            if width_of == n:
                break
            width *= 2
            levels.append(np.append(rank, -1).astype(np.int32))
        self.rank = rank
        i, j, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):  # neighbours agree on fewer words than the next level has
            common += (levels[k][i + common] == levels[k][j + common]).astype(np.int64) << k
        self.common = common
        self.most = int(common.max(initial=0))
        self.minima: list[np.ndarray] = []

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and at ``b``, which differ."""
        if not self.minima:
            level, half = self.common.astype(np.int32), 1
            self.minima.append(level)
            while len(level) > half:
                level = np.minimum(level[:-half], level[half:])
                self.minima.append(level)
                half *= 2
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        exponent = np.frexp(high - low)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(exponent):
            at = np.flatnonzero(exponent == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        return out


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period: maximal stretches with that smallest period, of at
    least LEAST words and REPEATS periods.

    For each period p the suffixes at jp and (j + 1)p are compared forward and, in the reversed text, backward: what they
    share on both sides and p words more is the stretch with period p around them. A run meets the grid first less than p
    words after its start, so there it shares more than (REPEATS - 2) p words forward; only such pairs are asked backward.
    The longest prefix that any two suffixes share bounds p, and rules out most texts at once.
    """
    n = len(words)
    if n < LEAST:
        return []
    names: dict[bytes, int] = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, n)
    forward = Suffixes(codes)
    if forward.most < LEAST - 1:
        return []
    longest = max(1, min(n // REPEATS, forward.most // (REPEATS - 1)))
    periods = np.arange(1, longest + 1)
    points = (n - 1) // periods  # j = 0, 1, ... with (j + 1)p < n
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends = np.cumsum(points)
    first = 0
    while first < longest:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        p = np.repeat(periods[first:last], points[first:last])
        at = (np.arange(len(p)) - np.repeat(ends[first:last] - points[first:last] - (ends[first - 1] if first else 0), points[first:last])) * p
        for k in range(0, len(p), PAIRS):
            q, a = p[k : k + PAIRS], at[k : k + PAIRS]
            ahead = forward.alike(a, a + q)
            far = ahead >= np.where(q == 1, LEAST - 1, (REPEATS - 2) * q + 1)
            found.append((q[far], a[far], ahead[far]))
        first = last
    p, at, ahead = (np.concatenate(x) for x in zip(*found))
    if not len(p):
        return []
    del forward
    backward, behind, inner = Suffixes(codes[::-1]), np.zeros(len(p), np.int64), np.flatnonzero(at > 0)
    behind[inner] = backward.alike(n - at[inner], n - at[inner] - p[inner])
    length = p + ahead + behind
    keep = (behind < p) & (length >= np.maximum(LEAST, REPEATS * p))
    spans: dict[tuple[int, int], int] = {}
    for start, size, q in sorted(zip((at - behind)[keep].tolist(), length[keep].tolist(), p[keep].tolist()), key=lambda x: x[2]):
        spans.setdefault((start, size), q)  # a stretch with a smaller period is found again at its multiples
    return sorted(((s, size, q) for (s, size), q in spans.items()), key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) per row of ``docs``: all runs of its words by start and period, and its words without the
    repeats that ``runs_of`` finds.

    Words end at ASCII white space. A null text and one without a word have no run and collapse to the empty text.
    Repeated rows keep one output row each; an empty table gives an empty result. ``edit`` may replace a row's words, given its
    id, before they are searched. Each text is one task's own work, in memory that is some log2(n) integers a word; no
    row meets another, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                runs, rest = [], []
                for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    words = (text or b"").split()
                    if edit:
                        words = edit(key, words)
                    runs.append(runs_of(words))
                    rest.append(collapsed(words, runs[-1]))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, kind), pa.array(rest, pa.binary())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {RUNS}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words of a document: a tenth of the documents, by the checksum of their id, repeat a stretch of their own
    words to their end. A null id has no checksum and keeps its words."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(read(spark, sf_dir, "documents"), edit=planted)
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("b.l"), F.col("b.p")
    return rows.select("doc_id", "n_runs", F.col("b.s").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
