"""What several operators of this subpackage share: reading, reliable checkpoints, bounded prefix sums."""

from __future__ import annotations

import gc
import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the contracts (space, tab to carriage return), for Java's regex.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts that reach a Python worker at a time.
TEXTS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now hands at most TEXTS rows at a time to Python workers, so that a worker's memory does not
    hang on the length of texts times Spark's default of 10,000. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= TEXTS:
        conf.set(key, str(TEXTS))
    return df


def sliced(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose values of ``column`` (binary) have at most ``most`` bytes, or that are one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    The folder is set here only where the session names none, and then only on a local master: executors of a
    cluster would not see each other's files.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "lumora-checkpoints")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that are worth a task; tasks of a narrowed frame at least.
ROWS_A_TASK, TASKS = 1 << 16, 12


def narrowed(df: DataFrame, rows: int, each: int = ROWS_A_TASK) -> DataFrame:
    """``df``, of some ``rows`` rows, in no more partitions than these are worth; with many rows it stays as it is.

    Each map task leaves files in every shuffle and each task takes pages of memory, however few its rows are. In a loop
    of shuffles over few rows these cost more than the rows do.
    """
    return df.coalesce(max(TASKS, math.ceil(rows / each)))


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint of ``df``, narrowed, and its number of rows."""
    df = checkpointed(df)
    rows = df.count()
    return narrowed(df, rows), rows


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames that nothing refers to any more. It does so only when
    the driver collects its garbage, which a driver that holds little rarely does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_words(text: Column) -> Column:
    """Number of white-space separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(h: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return (h.cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))


def sampled(rows: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``n`` of ``rows``, by the hash of id and text. For a model's fit only.

    Rows are counted first, so that each task hands over its few rows below the hash that some 2 n rows lie under;
    what reaches the driver does not grow with the number of tasks. Rows that repeat an id, or have none, are chosen
    by their texts; rows that repeat both count as often as they occur.
    """
    h = F.xxhash64(id_col, text_col)
    total = rows.count()
    below = rows.where(fraction(h) < 2 * n / total) if total > 2 * n else rows
    return below.orderBy(h, id_col).limit(n)


def hash_bucket(h: Column, bits: int = 10) -> Column:
    """The leading ``bits`` of a 64-bit hash: ranges in the order of the hash itself."""
    return F.shiftright(h, 64 - bits)


def bucket_bits(rows: int) -> int:
    """Bits of ``hash_bucket`` that leave some 2**17 rows a bucket, 10 at least."""
    return max(10, math.ceil(math.log2(max(rows, 1) / (1 << 17))))


def running_total(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows before this one of its group, without one task per group.

    ``bucket`` is an integer that never falls along ``order``. Each (group, bucket) is summed alone and shifted by
    the total of the buckets before it, so a group that holds a third of all rows is spread over many tasks; only
    one row per bucket meets in a group's window. Null groups are groups of their own.
    """
    cut = df.withColumn("_v", value).withColumn("_b", bucket)
    keys = [*group, "_b"]
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys).agg(F.sum("_v").alias("_t"))
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_o", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return cut.join(totals, same, "left").select(*df.columns, (F.col("_s") + F.col("_o")).cast("long").alias(out))
