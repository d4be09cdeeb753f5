"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.common import checkpointed, narrowed, read, release, settled, sliced, text_batches
from lumora.llm.graph import components


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 when there is no word.

    A-Z is lower-cased, words end at ASCII white space; fewer words than ``shingle`` make one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (np.concatenate(([0], ends[:-1])))[: n - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed bigint, one row per row of ``docs``; null and word-less texts get 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    rows = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    """A 64-bit pattern as the bigint that has it."""
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, distance: int = 2, segments: int = 2) -> DataFrame:
    """(a, b): representatives of two distinct fingerprints that differ in 1 to ``distance`` bits.

    ``prints`` has one row per distinct fingerprint (fp, rep). A fingerprint is cut into ``segments`` equal
    segments with search radii r_i, where the sum of r_i + 1 is ``distance`` + 1: two fingerprints within the
    distance are within r_i in some segment i. Each fingerprint is filed under its segment values and looked up
    under each value in the Hamming ball around them; the whole distance is verified in the join itself.
    """
    if not 1 <= segments <= distance + 1 or 64 % segments:
        raise ValueError("segments must divide 64 and be at most distance + 1")
    width = 64 // segments
    radii = [(distance + 1) // segments - 1 + (i < (distance + 1) % segments) for i in range(segments)]
    mask = _signed((1 << width) - 1)

    def ball(radius: int) -> list[int]:
        found = {0}
        for _ in range(radius):
            found |= {x ^ (1 << i) for x in found for i in range(width)}
        return sorted(found)

    part = [F.shiftrightunsigned("fp", width * (segments - 1 - i)).bitwiseAND(F.lit(mask)) for i in range(segments)]
    filed = F.array(*[F.struct(F.lit(i).alias("seg"), part[i].alias("key")) for i in range(segments)])
    balls = [
        F.array(*[F.struct(F.lit(i).alias("seg"), part[i].bitwiseXOR(F.lit(_signed(m)).cast("long")).alias("key")) for m in ball(r)])
        for i, r in enumerate(radii)
    ]
    tables = prints.select(F.col("fp").alias("fp_b"), F.col("rep").alias("b"), F.explode(filed).alias("k")).select("fp_b", "b", "k.seg", "k.key")
    probes = prints.select(F.col("fp").alias("fp_a"), F.col("rep").alias("a"), F.explode(F.concat(*balls)).alias("k")).select("fp_a", "a", "k.seg", "k.key")
    near = (F.col("fp_a") < F.col("fp_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance)
    tables, probes = tables.alias("t"), probes.alias("p")
    return probes.join(tables, (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``.

    component_id is the smallest id reachable over links of at most ``distance`` differing bits. A row with a null
    id has the component of the rows with its fingerprint; a fingerprint that only null ids have links with nothing
    and has no component. Repeated rows keep one output row each. An empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(prints.where("rep IS NOT NULL"), distance))
    classes = prints.join(found, prints["rep"] == found["v"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(classes, rows["fp"] == classes["_fp"], "left").select("doc_id", "fp", "component_id")


#: Sets that share one shingle beyond which not all of them meet, and rounds in which groups of copies are joined before.
HOT, ROUNDS = 1024, 2
#: Bits by which the rounds rule out pairs before their texts are read; columns of them, of a set and of another.
CHECK_BITS, CHECKS, OTHERS = 192, ("c0", "c1", "c2"), ("t0", "t1", "t2")
#: Pairs of whole sets, or sets, that are worth a task.
SETS_A_TASK = 1 << 12
#: Most bits of the filter that spares texts in no pair; with more ids it lets more texts through, and loses none.
FILTER_BITS = 1 << 25
#: Slots in which shingles are counted to tell rare from frequent ones, 4 bytes each; shingles that share one count together.
#: BLOCK of them make a row.
SLOTS, BLOCK = 1 << 20, 1 << 13


def segments_for(n: int, least: float, miss: float) -> tuple[int, int]:
    """(width, segments) for ``n`` sets: so many segments, searched within one bit, that a pair of sets of Jaccard
    similarity ``least`` meets in none with probability at most ``miss``.

    Sets that similar have a cosine of at least 2 least / (1 + least), and each bit of their SimHashes differs with
    probability angle / pi. The width grows with the number of sets so that a key holds a bounded number of them.
    """
    width = min(40, max(6, math.ceil(math.log2(max(n, 2))) - 8))
    share = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    meets = (1 - share) ** width + width * share * (1 - share) ** (width - 1)
    return width, 1 if meets >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - meets)))


def check_distance(least: float, miss: float, bits: int = CHECK_BITS) -> int:
    """Of ``bits`` bits of the SimHashes of two large sets at Jaccard similarity ``least``, so many as differ at most but with
    probability ``miss``. Sets of a few shingles differ in more: where 4 of 5 are shared, beyond the bits for 1e-9 with 2e-6."""
    share = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    beyond, d = 1.0, -1
    while beyond > miss and d < bits:
        d += 1
        beyond = math.fsum(math.comb(bits, x) * share**x * (1 - share) ** (bits - x) for x in range(d + 1, bits + 1))
    return d


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; none when there is no word. Words as in ``fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, joined, n = xxhash.xxh64_intdigest, b" ".join(words), len(words)
    if n <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64))


def long_fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of a set of 64-bit hashes in ``bits`` bits, as booleans: each 64 come from a further mix of the hashes."""
    words = -(-bits // 64)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14)]
        for w in range(words):
            x = h + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones[64 * w : 64 * w + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return (2 * ones > len(hashes))[:bits]


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles of the sets of ``texts`` (text) each of SLOTS slots has; these are all that reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for b in sliced(whole, "text", 1 << 20):
                x = np.concatenate([np.empty(0, np.uint64), *(shingles(t, width) for t in b.column("text").to_pylist())])
                total += np.bincount((x % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        blocks = np.minimum(total, (1 << 31) - 1).astype(np.int32).reshape(-1, BLOCK)
        for k in np.flatnonzero(blocks.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blocks[k].tobytes()])], ["k", "n"])

    def added(own: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for n in own.column("n"):
            total += np.frombuffer(n.as_py(), np.int32)
        return pa.table({"k": own.column("k").slice(0, 1), "n": pa.array([np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()])})

    counts = np.zeros((SLOTS // BLOCK, BLOCK), np.int32)
    for r in texts.select("text").mapInArrow(counted, "k int, n binary").groupBy("k").applyInArrow(added, "k int, n binary").collect():  # SLOTS / BLOCK rows
        counts[r["k"]] = np.frombuffer(r["n"], np.int32)
    return counts.reshape(-1)


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) per row of ``docs``.

    component_id is the smallest id reachable over links of texts whose sets of ``width``-word shingles have a Jaccard
    similarity of at least ``least``, and of rows that share an id. Rows with one set are one vertex; texts without a
    word have one set. A row with a null id links its set's neighbours to nothing: a set that only null ids have has
    no vertex and no component.

    Candidates share a rare shingle. All sets order their shingles by how many shingles share a shingle's slot, then by the
    shingle; any order that is one for all sets is exact. Two similar sets share some o >= least / (1 + least) (n + n') of
    their n and n' shingles, and all of these stand at or behind the first that they share. So that one has o places left in
    either set, and is among the first n - least n + 1. Only these are dealt out, those of a single set go at once, and two
    sets meet where a shingle has places enough left in both. Edited copies of one text that are too far apart to link have
    their edits first and too few places after them. All candidates are verified on their exact sets.

    Groups of copies are joined first: in ROUNDS rounds each set meets one set of every shingle that it deals out, so k copies
    cost some k pairs a shingle. First it is that with the fewest places before the shingle, which is the least edited copy,
    then one drawn at random. Pairs too far apart in the check bits, those of SimHashes, wait for the search that follows, as
    one at ``least`` does with probability ``miss``, or more if its sets are small. This looks for all pairs of sets that are
    still apart, whatever their bits: under a shingle
    with more than HOT sets, those outside its largest part meet all others; under other ones all sets meet. So no pair is
    left out, and none within a part costs a row.
    """
    rows_in = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    name = lambda s: xxhash.xxh64_intdigest(s.tobytes(), 1)
    signed = lambda x: np.array(x, np.uint64).view(np.int64)
    counts = slot_counts(rows_in.where("doc_id IS NOT NULL"), width)

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            sets = [shingles(x, width) for x in t["text"]]
            check = np.packbits(np.array([long_fingerprint(s, CHECK_BITS) for s in sets]).reshape(len(sets), CHECK_BITS), axis=1).view(np.int64)
            first = []
            for s in sets:
                order = np.lexsort((s, counts[(s % np.uint64(SLOTS)).astype(np.int64)]))
                first.append(s[order[: len(s) - math.ceil(len(s) * least - 1e-9) + 1]].view(np.int64))
            yield pd.DataFrame({"doc_id": t["doc_id"], "v": signed([name(s) for s in sets]), "n": [len(s) for s in sets], "first": first, **{c: check[:, i] for i, c in enumerate(CHECKS)}})

    rows = checkpointed(rows_in.mapInPandas(signatures, f"doc_id long, v long, n int, first array<long>, {', '.join(f'{c} long' for c in CHECKS)}"))
    same_set = [F.first(c).alias(c) for c in ("n", *CHECKS)]
    owned = rows.where("doc_id IS NOT NULL")
    vertices, n_sets = settled(owned.groupBy("v").agg(F.min("doc_id").alias("rep"), *same_set))
    dealt = owned.groupBy("v").agg(F.first("n").alias("n"), F.first("first").alias("first")).select("v", "n", F.posexplode("first").alias("i", "x"))
    # of each shingle dealt out: its set, and how many places that has from it on
    shared = dealt.select("x", "v", (F.col("n") - F.col("i")).alias("left")).withColumn("c", F.count("*").over(Window.partitionBy("x"))).where("c > 1").drop("c")
    shared, n_shared = settled(shared)
    release(docs.sparkSession)

    def filed_by(part: DataFrame, *bits: str) -> DataFrame:
        """The shingles that sets share, with the sets' sizes, parts and check bits ``bits``."""
        known = vertices.join(part.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left")
        return narrowed(shared.join(known.select("v", "n", *bits, F.coalesce("component", "v").alias("part")), "v"), n_shared)

    def other_side(side: DataFrame, *bits: str) -> DataFrame:
        return side.select(F.col("x").alias("tx"), *[F.col(c).alias(f"t{c}") for c in ("v", "n", "left", "part")], *[F.col(c).alias(t) for c, t in zip(bits, OTHERS)])

    apart = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(t))) for c, t in zip(CHECKS, OTHERS)])
    enough = F.least("left", "tleft") >= least / (1 + least) * (F.col("n") + F.col("tn")) - 1e-9
    fits = (F.col("part") != F.col("tpart")) & enough & (F.least("n", "tn") >= least * F.greatest("n", "tn") - 1e-9)
    # the smaller set of a pair, of equal ones that with the smaller name, is the other one
    ordered = (F.col("tn") < F.col("n")) | ((F.col("tn") == F.col("n")) & (F.col("tv") < F.col("v")))

    def contents(marks: np.ndarray):
        """The sets of the texts whose ids are marked: (v, s)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in batches:
                at = t["at"].to_numpy()
                sets = [shingles(x, width) for x in t["text"][(marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]]
                yield pd.DataFrame({"v": signed([name(s) for s in sets]), "s": [s.tobytes() for s in sets]})

        return run

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in p[c]] for c in ("s_a", "s_b"))
            both = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)]
            near = np.array([q >= least * (len(s) + len(t) - q) - 1e-9 for q, s, t in zip(both, x, y)], bool)
            yield p.loc[near, ["a", "b"]]

    def sets_of(ends: DataFrame) -> DataFrame:
        """(v, s): the sets of the vertices ``ends`` (v, once each); only texts of these are read again."""
        reps, n_reps = settled(narrowed(vertices.join(ends, "v", "left_semi").select(F.col("rep").alias("doc_id")), n_sets).distinct())
        bits = min(FILTER_BITS, max(64, 1 << (16 * n_reps).bit_length()))
        at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        marks = np.zeros(bits // 8, np.uint8)
        # one row per 8,192 places of the filter that hold an id
        places = reps.select(at.alias("at")).groupBy(F.expr("at div 8192").alias("k")).agg(F.collect_set(F.expr("int(at % 8192)")).alias("p"))
        for r in places.toLocalIterator():
            p = np.array(r["p"], np.int64) + r["k"] * 8192
            np.bitwise_or.at(marks, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        texts = rows_in.where("doc_id IS NOT NULL").select(at.alias("at"), "text").mapInPandas(contents(marks), "v long, s binary")
        return narrowed(checkpointed(texts.join(ends, "v", "left_semi").groupBy("v").agg(F.first("s").alias("s"))), n_reps, SETS_A_TASK)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of vertices that are similar."""
        pairs, n_pairs = settled(pairs.distinct())
        if not n_pairs:
            return pairs
        sets = sets_of(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct())
        both = pairs.join(sets.select(F.col("v").alias("b"), F.col("s").alias("s_b")), "b").join(sets.select(F.col("v").alias("a"), F.col("s").alias("s_a")), "a")
        return narrowed(checkpointed(narrowed(both, n_pairs, SETS_A_TASK).mapInPandas(similar, "a long, b long")), n_pairs)

    def met(asked: DataFrame, filed: DataFrame) -> DataFrame:
        return asked.join(filed, (F.col("x") == F.col("tx")) & ordered & fits).select(F.col("tv").alias("a"), F.col("v").alias("b"))

    # rows that share an id
    ids = owned.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z").select("doc_id", "a")
    same = checkpointed(rows.join(ids, "doc_id").select("a", F.col("v").alias("b")).where("a <> b").distinct())

    def drawn(part: DataFrame, number: int) -> DataFrame:
        """Pairs of each set with the ones drawn for its shingles, if they are in different parts, fit and are near; two a set at
        most, as the search that follows finds what is still apart. Names are hashes, so that nearest to a random one is a draw."""
        members = filed_by(part, *CHECKS)
        first = F.col("n") - F.col("left") if number == 0 else F.col("v").bitwiseXOR(F.lit(_signed(xxhash.xxh64_intdigest(b"draw", number))).cast("long"))
        hubs = members.groupBy("x").agg(F.min(F.struct(first.alias("o"), "v", "n", "left", "part", *CHECKS)).alias("h")).select("x", "h.*")
        pairs = members.join(other_side(hubs, *CHECKS), (F.col("x") == F.col("tx")) & fits & (apart <= check_distance(least, miss)))
        few = pairs.groupBy("v").agg(F.array_distinct(F.array(F.min("tv"), F.max("tv"))).alias("two")).select("v", F.explode("two").alias("tv"))
        return few.select(F.least("v", "tv").alias("a"), F.greatest("v", "tv").alias("b"))

    links, part = same, components(same)
    for number in range(ROUNDS):
        links = links.union(verified(drawn(part, number)))
        release(docs.sparkSession)
        part = components(links)
    asked = filed_by(part)
    # the smaller set of a pair has twice the smaller size's share left
    filed = other_side(asked.where(F.col("left") >= 2 * least / (1 + least) * F.col("n") - 1e-9))
    hot = checkpointed(asked.groupBy(F.col("x").alias("hx")).agg(F.count("*").alias("load")).where(F.col("load") > HOT).select("hx"))
    if not (n_hot := hot.count()):
        rest = met(asked, filed)
    else:
        small = F.broadcast if n_hot <= 1 << 20 else lambda x: x
        at_hot = lambda side, key, how: side.join(small(hot), F.col(key) == F.col("hx"), how)
        rest = met(at_hot(asked, "x", "left_anti"), at_hot(filed, "tx", "left_anti"))
        filed, asked = checkpointed(at_hot(filed, "tx", "left_semi")), checkpointed(at_hot(asked, "x", "left_semi"))
        sizes = asked.groupBy("x", "part").agg(F.count("*").alias("c"))
        main = small(checkpointed(sizes.groupBy(F.col("x").alias("mx")).agg(F.max_by("part", F.struct("c", "part")).alias("main"))))
        others_filed = filed.join(main, F.col("tx") == F.col("mx")).where("tpart <> main").drop("mx", "main")
        with_main = asked.join(main, F.col("x") == F.col("mx"))
        rest = rest.union(met(with_main.where("part <> main").drop("mx", "main"), filed)).union(met(with_main.where("part = main").drop("mx", "main"), others_filed))
    links = links.union(verified(rest))
    whole = components(links)
    least_id = vertices.join(whole.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left").select("v", "rep", F.coalesce("component", "v").alias("part"))
    lowest = least_id.groupBy("part").agg(F.min("rep").alias("component_id"))
    classes = least_id.join(lowest, "part").select(F.col("v").alias("_v"), "component_id")
    return rows.join(classes, rows["v"] == classes["_v"], "left").select("doc_id", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
