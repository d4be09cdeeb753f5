"""Packing by length: optimal buckets over the global length histogram, token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import bucket_bits, checkpointed, hash_bucket, n_words, read, running_total

#: Lengths below 2 * FINE have a bin each; above, a bin spans 1 / FINE of its power of two.
FINE = 256


def length_bin(n: Column) -> Column:
    """Bin of a length, growing with it: the length itself up to 2 * FINE, then FINE bins per power of two."""
    e = F.greatest(F.length(F.bin(n)) - F.lit(FINE.bit_length()), F.lit(0)).cast("long")
    return F.when(n < 2 * FINE, n).otherwise(e * FINE + F.floor(n / F.pow(F.lit(2.0), e)).cast("long"))


def histogram(lengths: DataFrame) -> DataFrame:
    """(bin, n, longest) over all rows of ``lengths`` (n_tokens). At most about 60 * FINE rows, whatever the table."""
    return lengths.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(F.count("*").alias("n"), F.max("n_tokens").alias("longest"))


def boundaries(n: list[int], longest: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets that minimise the padding, for bins in the order of length.

    Dynamic programming over the bins: the best cost of the first j bins in k buckets adds, to that of the first i
    bins in k - 1, the rows of bins i to j times the longest length of bin j. Lengths themselves are a constant.
    Among equal costs fewer buckets and the earlier cut win. No bins give no boundary.
    """
    if not n:
        return []
    rows = np.concatenate(([0.0], np.cumsum(np.array(n, float))))
    top = np.array(longest, float)
    cost = np.concatenate(([0.0], rows[1:] * top))
    cuts, best = [], cost.copy()
    size = len(n)
    kept = [np.zeros(size + 1, int)]
    for _ in range(1, min(buckets, size)):
        new, cut = np.full(size + 1, np.inf), np.zeros(size + 1, int)
        new[0] = 0.0
        for j in range(1, size + 1):
            tried = best[:j] + (rows[j] - rows[:j]) * top[j - 1]
            i = int(np.argmin(tried))
            new[j], cut[j] = tried[i], i
        kept.append(cut)
        if not new[size] < best[size]:
            kept.pop()
            break
        best = new
    j = size
    for cut in reversed(kept):
        cuts.append(int(longest[j - 1]))
        j = cut[j]
        if j == 0:
            break
    return cuts[::-1]


def packed(lengths: DataFrame, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot, padding), one row per row of ``lengths`` (doc_id, n_tokens).

    A sequence is padded to its bucket's length; a batch holds as many as fit ``budget`` tokens, at least one, so
    a sequence longer than the budget is a batch of its own and nothing is cut. Rows are shuffled by a hash of the
    id before they fill batches; only the last batch of a bucket may be short. Null ids and repeated rows are
    packed like others, numbered among their equals so that they spread over all buckets of the hash; texts without tokens go to the shortest bucket.
    """
    # rows are nothing but id and length, so equal ones are one row and a number
    lengths = checkpointed(lengths.select("doc_id", F.col("n_tokens").cast("long")).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("_n")))
    total = lengths.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    lengths = lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k"))
    bins = histogram(lengths).orderBy("bin").collect()  # bounded by the bins, not by the rows
    ends = boundaries([b["n"] for b in bins], [b["longest"] for b in bins], buckets)
    n = F.col("n_tokens")
    bucket = sum([(n > e).cast("int") for e in ends[:-1]], F.lit(0))
    length = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends or [0]]), F.col("bucket") + 1)
    rows = lengths.withColumn("bucket", bucket).withColumn("bucket_len", length).withColumn("h", F.xxhash64("doc_id", "n_tokens", "_k"))
    rows = running_total(rows, ["bucket", "bucket_len"], hash_bucket(F.col("h"), bucket_bits(total)), [F.col("h"), F.col("doc_id"), n, F.col("_k")], F.lit(1), "place")
    room = F.greatest(F.expr(f"{budget} div greatest(bucket_len, 1)"), F.lit(1).cast("long"))
    rows = rows.withColumn("room", room)
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.expr("place div room").alias("batch"), F.expr("place % room").alias("slot"),
        (F.col("bucket_len") - n).alias("padding"),
    )


def pack_documents(docs: DataFrame, **options: int) -> DataFrame:
    """``packed`` with white-space separated words as tokens; a null text has none."""
    return packed(docs.select(F.col("doc_id").cast("long"), n_words(F.col("text")).alias("n_tokens")), **options)


def op1_pack_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
