"""Exact removal of repeated byte strings: Burrows-Wheeler transforms of shards, merged by refining their interleave."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import checkpointed, read, sliced

#: Bytes of a repeated string, and of the gram that two equal strings are brought together by.
LENGTH, GRAM = 200, 48
#: Most bits of the filter that spares pieces whose anchor occurs once; with more anchors it lets more through, and loses none.
FILTER_BITS = 1 << 27
#: Bytes of pieces that a task merges, occurrences of an anchor beyond which its pieces are cut, and windows of such a cut.
TASK_BYTES, HOT, CUT = 16 << 20, 1 << 16, 8
#: Bytes of texts that a task works on at a time.
SLICE = 4 << 20

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Pieces(NamedTuple):
    """Runs of windows that share an anchor: the first and last window's start, the anchor's place, and its hash."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


def pieces_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Pieces:
    """All windows of ``length`` bytes of the texts, laid end to end, by their anchors.

    A window's anchor is the gram in it with the least hash, the leftmost of equal ones, so equal windows have equal anchors at
    equal places. Neighbouring windows mostly share theirs: a piece has some (length - gram) / 2 windows.
    """
    data = np.frombuffer(b"".join(texts) + bytes(gram + 8), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    starts = (ends - sizes)[sizes >= length]
    if not len(starts):
        return Pieces(*[np.empty(0, np.int64)] * 3, np.empty(0, np.uint64))
    word = np.lib.stride_tricks.as_strided(data.view(), (n + gram, 8), (1, 1)).copy().view(np.uint64).ravel()
    word *= M1
    word ^= word >> np.uint64(31)
    h = word[: n].copy()
    for at in range(8, gram - 7, 8):  # grams in steps of eight bytes
        h *= M2
        h += word[at : at + n]
    del word
    h ^= h >> np.uint64(29)
    h *= M3
    h ^= h >> np.uint64(32)
    span = length - gram + 1  # grams of a window
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    held = 1
    while 2 * held <= span:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    if held < span:
        least = np.minimum(least[: len(least) - (span - held)], least[span - held :])
    # windows inside a text
    counts = sizes[sizes >= length] - length + 1
    window = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = window[new], window[np.append(new[1:], len(window)) - 1]
    return Pieces(first, last, anchor[new], h[anchor[new]])


def distinct_texts(batch: pa.RecordBatch) -> dict[bytes, tuple[bytes, int]]:
    """md5 -> (text, copies) of a batch's texts that can hold a repeated string."""
    out: dict[bytes, tuple[bytes, int]] = {}
    for text in batch.column("text").to_pylist():
        key = hashlib.md5(text, usedforsecurity=False).digest()
        out[key] = (text, out[key][1] + 1 if key in out else 1)
    return out


def long_texts(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    return docs.select(F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text") >= length)


def anchor_counts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, n): how often each anchor occurs, copies of a text counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                held = distinct_texts(b)
                p = pieces_of([t for t, _ in held.values()], length, gram)
                ends = np.cumsum([len(t) for t, _ in held.values()])
                copies = np.array([c for _, c in held.values()], np.int64)[np.searchsorted(ends, p.first, "right")]
                h, at = np.unique(p.hash, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, copies, len(h)).astype(np.int64))], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def filter_of(anchors: DataFrame, n: int) -> np.ndarray:
    """Bits that are set at the places of ``anchors`` (h), ``n`` of them; sixteen or more a place until FILTER_BITS. One row of
    the driver's holds 8,192 places."""
    bits = min(FILTER_BITS, max(1 << 13, 1 << (16 * n).bit_length()))
    marks = np.zeros(bits // 8, np.uint8)
    at = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    for r in anchors.select(at.alias("at")).groupBy(F.shiftright("at", 13).alias("k")).agg(F.collect_set(F.col("at").bitwiseAND(F.lit(8191)).cast("int")).alias("p")).toLocalIterator():
        block = np.zeros(8192, np.uint8)
        block[r["p"]] = 1
        marks[r["k"] * 1024 : (r["k"] + 1) * 1024] = np.packbits(block, bitorder="little")
    return marks


def marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(marks) - 1)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def cut(p: Pieces, hot: np.ndarray, length: int, data: bytes) -> Pieces:
    """Pieces of a hot anchor, cut into blocks of CUT windows at fixed places around it, each with the hash of the bytes that all
    windows of its block hold. Equal windows are in blocks of one hash, and other texts around a common passage part."""
    if not len(hot):
        return p
    at = np.searchsorted(hot, p.hash)
    is_hot = hot[np.minimum(at, len(hot) - 1)] == p.hash
    if not is_hot.any():
        return p
    first, last, anchor, h = ([x[~is_hot]] for x in p)
    for a, z, k, x in zip(*(x[is_hot].tolist() for x in p)):
        blocks = range((k - z) // CUT, (k - a) // CUT + 1)
        first.append(np.array([max(a, k - CUT * b - CUT + 1) for b in blocks]))
        last.append(np.array([min(z, k - CUT * b) for b in blocks]))
        anchor.append(np.full(len(blocks), k))
        h.append(np.array([xxhash.xxh64_intdigest(data[k - CUT * b : k - CUT * b - CUT + 1 + length], (x + b) & (2**64 - 1)) for b in blocks], np.uint64))
    return Pieces(*(np.concatenate(x) for x in (first, last, anchor, h)))


def repeated_pieces(batch: pa.RecordBatch, marks: np.ndarray, hot: np.ndarray, length: int, gram: int):
    """(piece, name, text's key, copies, start in the text, offset of the anchor, hash) of a batch's pieces with a marked anchor."""
    held = distinct_texts(batch)
    texts = [t for t, _ in held.values()]
    p = pieces_of(texts, length, gram)
    keep = marked(marks, p.hash)
    data = b"".join(texts)
    p = cut(Pieces(*(x[keep] for x in p)), hot, length, data)
    ends = np.cumsum([len(t) for t in texts])
    of = np.searchsorted(ends, p.first, "right")
    keys, copies = list(held), [c for _, c in held.values()]
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    for a, z, k, h, t in zip(p.first.tolist(), p.last.tolist(), p.anchor.tolist(), p.hash.view(np.int64).tolist(), of.tolist()):
        piece = data[a : z + length]
        yield piece, xxhash.xxh3_64_intdigest(piece) - (1 << 63), keys[t], copies[t], a - int(begins[t]), k - a, h


class Shard(NamedTuple):
    """Pieces laid out around their anchors, as their positional Burrows-Wheeler transform: ``bwt[c]`` has the bytes of column c
    in the order of what follows them, ``order[c]`` the pieces in the order of the strings from column c on."""

    bwt: np.ndarray
    order: np.ndarray


def transform(columns: np.ndarray, windows: int) -> Shard:
    """The transform of ``columns``, one row a column; orders are kept for the first ``windows`` columns."""
    width, n = columns.shape
    bwt, orders, order = np.empty((width, n), np.uint8), np.empty((windows, n), np.int32), np.arange(n)
    for c in range(width - 1, -1, -1):
        bwt[c] = columns[c][order]
        order = order[np.argsort(bwt[c], kind="stable")]
        if c < windows:
            orders[c] = order
    return Shard(bwt, orders)


def minima(values: np.ndarray) -> np.ndarray:
    """Row k holds the least of each 2**k values in a row."""
    table = np.empty((max(1, len(values).bit_length()), len(values)), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        half = 1 << (k - 1)
        table[k] = table[k - 1]
        np.minimum(table[k - 1][:-half], table[k - 1][half:], out=table[k][:-half])
    return table


def least_between(table: np.ndarray, log: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value after ``low`` up to ``high``."""
    k = log[high - low]
    return np.minimum(table[k, low + 1], table[k, high - (1 << k) + 1])


def merged_repeats(shards: list[Shard], weight: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """Whether each piece's window at each offset left of the anchor occurs at least twice, as a table (piece, offset).

    The shards' transforms are merged by refinement: the interleave says from which shard each place of the merged order
    comes. It starts as one shard after the other, and each column deals its places out by the transform's byte
    there, in order, so that it is right for one byte more. No string is compared and none sorted again. Neighbours that
    go with the same byte share one byte more than the least that was shared between them before; where that reaches
    ``length``, neighbouring windows are one repeated interval. ``weight`` counts each piece; its windows lie at offsets
    ``least`` to ``most``.
    """
    windows, n = shards[0].order.shape[0], len(weight)
    base = np.cumsum([0, *[s.bwt.shape[1] for s in shards]])
    bwt = np.concatenate([s.bwt for s in shards], axis=1)
    orders = np.concatenate([s.order + b for s, b in zip(shards, base)], axis=1)
    came_from = np.repeat(np.arange(len(shards), dtype=np.uint16), np.diff(base))
    place = np.arange(n)  # of the merged order, shard by shard
    log = np.maximum(np.frexp(np.arange(n + 1))[1] - 1, 0)
    shared = np.zeros(n, np.uint16)
    table = minima(shared)
    found = np.zeros((n, windows), bool)
    for c in range(len(bwt) - 1, -1, -1):
        byte = np.empty(n, np.uint8)
        byte[place] = bwt[c]
        turn = np.argsort(byte, kind="stable")
        came_from = came_from[turn]
        place = np.argsort(came_from, kind="stable")
        byte = byte[turn]
        same = np.flatnonzero(byte[1:] == byte[:-1])
        shared = np.zeros(n, np.uint16)
        shared[same + 1] = np.minimum(least_between(table, log, turn[same], turn[same + 1]), length - 1) + 1
        table = minima(shared)
        if c < windows:
            rows = np.empty(n, np.int64)
            rows[place] = orders[c]
            offset = windows - 1 - c
            at = np.flatnonzero((least[rows] <= offset) & (offset <= most[rows]))
            if len(at):
                alone = np.concatenate(([True], least_between(table, log, at[:-1], at[1:]) < length))
                rows, of = rows[at], np.cumsum(alone) - 1
                found[rows, offset] = np.bincount(of, weight[rows])[of] >= 2
    return found


def repeats_in(pieces: list[list[tuple[bytes, int, int]]], length: int, gram: int) -> np.ndarray:
    """(piece, start, end): stretches of bytes of each piece that repeated windows cover. ``pieces``: one list a shard of
    (bytes, offset of the anchor, times)."""
    left = length - gram  # most bytes left of an anchor
    shards = []
    for shard in pieces:
        columns = np.zeros((len(shard), left + length), np.uint8)
        for i, (piece, offset, _) in enumerate(shard):
            columns[i, left - offset : left - offset + len(piece)] = np.frombuffer(piece, np.uint8)
        shards.append(transform(np.ascontiguousarray(columns.T), left + 1))
    every = [x for shard in pieces for x in shard]
    offset = np.array([x[1] for x in every])
    least = offset - np.array([len(x[0]) for x in every]) + length
    found = merged_repeats(shards, np.array([x[2] for x in every], np.float64), least, offset, length)
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, lowest = np.nonzero(edge == 1)
    highest = np.nonzero(edge == -1)[1] - 1
    return np.stack([rows, offset[rows] - highest, offset[rows] - lowest + length], axis=1)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """(key, spans): for the md5 of each text that holds one, the stretches (start, end) of bytes that strings of ``length`` bytes
    cover which also start elsewhere, in another text or the same one; they may overlap.

    Texts are cut at anchors (``pieces_of``), and pieces are dealt out by their anchor's hash, so equal windows meet in one
    task, whose size is set by the number of pieces. There each batch of pieces is a shard with its own transform, and
    the shards are merged (``merged_repeats``). Equal pieces of a batch travel once, with their number; only pieces whose
    anchor occurs twice travel at all. An anchor that more than HOT pieces have is cut (``cut``), so no anchor is one
    group. Results go back to the texts by a join on the piece.
    """
    texts = long_texts(docs, text_col, length)
    anchors = checkpointed(anchor_counts(texts, length, gram).where("n > 1"))
    n, total = anchors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(HOT, total // 1_000_000)  # a million hot anchors at most
    hot = np.sort(np.array([r["h"] for r in anchors.where(F.col("n") > limit).select("h").collect()], np.int64).view(np.uint64))
    marks = filter_of(anchors, n)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (length + (length - gram) / 2) / TASK_BYTES))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                held: dict[tuple[int, int], list] = {}
                for piece, name, _, copies, _, offset, h in repeated_pieces(b, marks, hot, length, gram):
                    if (h, name) in held:
                        held[h, name][2] += copies
                    else:
                        held[h, name] = [piece, offset, copies]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*[(*k, *v) for k, v in held.items()]), kinds)] if held else [pa.array([], k) for k in kinds], ["h", "name", "piece", "offset", "copies"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        shards: list[list[list]] = []
        for b in batches:
            new = []
            for h, name, piece, offset, copies in zip(*(b.column(c).to_pylist() for c in ("h", "name", "piece", "offset", "copies"))):
                if (h, name) in seen:
                    seen[h, name][2] += copies
                else:
                    seen[h, name] = x = [piece, offset, copies]
                    new.append(x)
            if new:
                shards.append(new)
        if shards:
            keys = np.array(list(seen), np.int64)
            spans = repeats_in(shards, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[spans[:, 0], 0], keys[spans[:, 0], 1], spans[:, 1], spans[:, 2])], ["h", "name", "start", "end"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                rows = [(h, name, key, at) for _, name, key, _, at, _, h in repeated_pieces(b, marks, hot, length, gram)]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["h", "name", "key", "at"])

    found = texts.mapInArrow(pieces, "h long, name long, piece binary, offset int, copies long").repartition(tasks, "h").mapInArrow(merge, "h long, name long, start long, end long")
    of = texts.mapInArrow(places, "h long, name long, key binary, at long")
    spans = of.join(found, ["h", "name"]).select("key", F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")).alias("span"))
    return spans.groupBy("key").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) per row of ``docs``: the maximal stretches (start, end) of bytes that repeated strings
    cover, and the bytes that remain.

    All strings are judged on the input: of copies none stays. Texts are UTF-8; null is the empty text. Texts shorter than
    ``length`` stay whole. Rows may repeat or lack an id; each has its own output row. An empty table gives an empty
    result. A stretch may end inside a character; ``kept`` is binary for that reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                removed, kept = [], []
                for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                    out: list[list[int]] = []
                    for s in sorted((x["start"], x["end"]) for x in spans or ()):
                        if out and s[0] <= out[-1][1]:
                            out[-1][1] = max(out[-1][1], s[1])
                        else:
                            out.append([*s])
                    edges = [0, *(x for s in out for x in s), len(text)]
                    removed.append([{"start": a, "end": z} for a, z in out])
                    kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2])) if out else text)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                sizes = pa.array([len(x) for x in b.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    both = rows.join(repeated_spans(docs, length, gram, text_col).hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary")


def op13_merged_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(read(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
