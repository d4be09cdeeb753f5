"""Mixing sources to target weights with a golden-ratio schedule over equal-token blocks (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.common import bucket_bits, checkpointed, hash_bucket, n_words, read, running_total

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Fractional parts of 1 / phi and of 2**20 / phi.
GOLDEN, GOLDEN_20 = 0.6180339887498949, 0.607787409740351
#: Cells that the unit interval is cut into to look up a point's source by equality.
CELLS = 4096
#: Consecutive slots that are ranked together.
CHUNK = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source of ``sizes`` (source, size).

    The sources share ``share`` times all sizes by weight. A target stops at ``repeats`` times its source's size
    and the excess is shared again by weight among the others until none is above; that fixed point is found in
    one pass over the sources in the order of size to weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    w = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("full", F.col("most") <= F.col("w") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return by.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * level).alias("target"))


def golden(i: Column) -> Column:
    """The i-th point of the golden-ratio sequence in [0, 1), exact to about 1e-9 up to 2**40 points."""
    high, low = F.shiftright(i, 20).cast("double"), i.bitwiseAND(F.lit((1 << 20) - 1)).cast("double")
    x = high * F.lit(GOLDEN_20) + low * F.lit(GOLDEN)
    return x - F.floor(x).cast("double")


def blocks_of(quota: Column, block_words: int) -> Column:
    return F.ceil(quota / F.lit(block_words)).cast("long")


def slots(spark: SparkSession, aims: DataFrame, n: int) -> DataFrame:
    """(slot, source, rank): source of each of ``n`` slots and how many earlier slots that source has.

    A slot's point falls into the interval that its source holds in the cumulative targets. Points are matched by
    the cell of the unit interval that they lie in, so no point is compared with all sources.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(Window.partitionBy(F.lit(1)))
    upto = F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = aims.where("target > 0").select("source", ((upto - F.col("target")) / total).alias("lo"), (upto / total).alias("hi"))
    # the last interval reaches 1 whatever the rounding
    held = held.withColumn("hi", F.when(F.col("hi") == F.max("hi").over(Window.partitionBy(F.lit(1))), F.lit(1.0)).otherwise(F.col("hi")))
    cells = held.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    points = spark.range(n).select(F.col("id").alias("slot"), golden(F.col("id")).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    found = points.join(cells, (points["cell"] == cells["cell"]) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "source")
    return running_total(found, ["source"], F.expr(f"slot div {CHUNK}"), [F.col("slot")], F.lit(1), "rank")


def turns(spark: SparkSession, aims: DataFrame, block_words: int) -> DataFrame:
    """(slot, source, rank) of every block of every source of ``aims``.

    There are as many slots as blocks. A source that holds p of the unit interval gets p n of them, give or take some log2 n, so
    a few of its blocks may be left, above all where sources are smaller than a block. These stand behind the slots in
    a shuffled order. The number of slots never hangs on the smallest source.
    """
    n = aims.agg(F.coalesce(F.sum(blocks_of(F.col("quota"), block_words)), F.lit(0))).first()[0]
    given = checkpointed(slots(spark, aims, n))
    had = given.groupBy(F.col("source").alias("_g")).agg(F.count("*").alias("had"))
    short = aims.join(had, F.col("source").eqNullSafe(F.col("_g")), "left").select("source", F.coalesce("had", F.lit(0)).alias("had"), blocks_of(F.col("quota"), block_words).alias("blocks"))
    rest = short.where("had < blocks").select("source", F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)).alias("rank")).withColumn("_h", F.xxhash64("source", "rank"))
    rest = running_total(rest, [], hash_bucket(F.col("_h")), [F.col("_h"), F.col("source").asc_nulls_last(), F.col("rank")], F.lit(1), "slot")
    return given.unionByName(rest.select((F.col("slot") + n).alias("slot"), "source", "rank"))


def schedule(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: float = 2.0, block_words: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``sized`` (doc_id, source, size, tag), as (pieces, placed, aims).

    aims: ``targets``. placed: the documents with words, with their source's columns and ``start``, their place in
    the source's stream of words, shuffled by ``tag``. pieces: (slot, source, block, doc_id, tag, start, size, lap,
    from_word, n_words), the words of a document that a slot takes. A source's stream, run through in as many laps as
    needed, is cut into blocks of ``block_words``; its r-th slot takes its r-th block, and its last block ends at the
    rounded target, after which the schedule passes it over. What no slot takes is not in the mix.

    Documents without words have no pieces. Repeated rows are documents of their own. Null sources are a source.
    """
    aims = checkpointed(targets(sized, weights, share, repeats).withColumn("quota", F.round("target").cast("long")))
    order = [F.col("tag"), F.col("doc_id"), F.col("size")]
    worded = sized.where("size > 0")
    placed = running_total(worded, ["source"], hash_bucket(F.col("tag"), bucket_bits(sized.count())), order, F.col("size"), "start")
    a = aims.select(F.col("source").alias("_s"), "source_size", "target", "quota")
    placed = placed.join(a, placed["source"].eqNullSafe(a["_s"]), "left").drop("_s")
    laps = placed.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(repeats) - 1)))).withColumn("at", F.col("start") + F.col("source_size") * F.col("lap"))
    laps = laps.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota"))).where("at < end")
    cut = laps.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(end - 1) div {block_words}"))))
    first = F.greatest("at", F.col("block") * block_words)
    cut = cut.select(
        "source", "block", "doc_id", "tag", "start", "size", "lap", (first - F.col("at")).alias("from_word"),
        (F.least(F.col("end"), (F.col("block") + 1) * block_words) - first).alias("n_words"),
    )
    own = turns(sized.sparkSession, aims, block_words).select("slot", F.col("source").alias("_s"), "rank")
    pieces = cut.join(own, cut["source"].eqNullSafe(own["_s"]) & (cut["block"] == own["rank"])).drop("_s", "rank")
    return pieces, placed, aims


def mixed(sized: DataFrame, **options: object) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, n_slots) for each row of ``sized``: the words that
    slots take of it, repeats counted, the first of these slots (null if there is none) and their number."""
    pieces, placed, aims = schedule(sized, **options)
    key = ["source", "start", "doc_id", "size"]
    none = placed.select(*key, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("long").alias("slot"))
    taken = pieces.select(*key, "n_words", "slot").unionByName(none).groupBy(*key)
    taken = taken.agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    zero = F.lit(0).cast("long")
    every = taken.select("doc_id", "source", "size", "taken", "first_slot", "n_slots").unionByName(
        sized.where("size = 0").select("doc_id", "source", "size", zero.alias("taken"), F.lit(None).cast("long").alias("first_slot"), zero.alias("n_slots"))
    )
    a = aims.select(F.col("source").alias("_s"), "source_size", "target")
    return every.join(a, every["source"].eqNullSafe(a["_s"]), "left").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def tag_of(docs: DataFrame) -> Column:
    """Hash of a document's id, source and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["text"].cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tag) of documents; a null text has size 0."""
    return checkpointed(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), tag_of(docs).alias("tag")))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` in the order of the mix, each row once for every lap in which slots take half of its words or more.

    Only the document at the end of a source's last lap is taken in part; it is kept or left as a whole. A copy stands
    at its first slot of its lap; partitions follow each other in the order of the slots, and so do rows within
    them. Rows that repeat id, source and text are taken alike. Rows without words are left out.
    """
    pieces, _, _ = schedule(sized(docs), **options)
    laps = pieces.groupBy("source", "start", "tag", "size", "lap").agg(F.sum("n_words").alias("n"), F.min("slot").alias("slot"))
    copies = checkpointed(laps.groupBy("tag", "lap").agg(F.avg(F.col("n") / F.col("size")).alias("share"), F.min("slot").alias("_slot")).where("share >= 0.5").select(F.col("tag").alias("_tag"), "_slot"))
    last = copies.agg(F.max("_slot")).first()[0] or 0
    taken = docs.select(F.struct("*").alias("_row"), tag_of(docs).alias("_own")).join(copies, F.col("_own") == F.col("_tag"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("_slot") * n / (last + 1)).cast("int")
    return taken.repartitionById(n, part).sortWithinPartitions("_slot", "_tag").select("_row.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(sized(read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")
