"""Places in a global order, running sums and as-of look-ups that no key or order puts into one task; reliable checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places that a window over an order, or over one key's rows, holds.
SPAN = 1 << 14


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors see: spark.checkpoint.dir; on a local master without it, ``name`` in the temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), name)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in ``shared_folder``."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession, "lumora-checkpoints"))
    return df.checkpoint(eager=True)


def placed(rows: DataFrame, order: list[str], counted: Column, place: str = "pos", before: str = "before") -> DataFrame:
    """``rows`` with their ``place`` in the order of these columns, from 0, and how many ``counted`` rows stand ``before`` them.

    Rows are dealt out by ranges of the order and sorted within them; a checkpoint holds them so. What the driver's plan
    joins in is one row a partition.
    """
    sorted_rows = checkpointed(rows.withColumn("_c", counted.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order))
    at = sorted_rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    sums = at.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_c").alias("_m"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_m")])
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumns({"_k": F.count("*").over(inside), "_s": F.coalesce(F.sum("_c").over(inside), F.lit(0))})
    at = at.join(F.broadcast(sums), F.col("_p") == F.col("_q"))
    return at.select(*rows.columns, (F.col("_n0") + F.col("_k")).alias(place), (F.col("_m0") + F.col("_s")).alias(before))


def running(rows: DataFrame, place: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of ``values`` over the rows at smaller places; spans of SPAN places are summed alone and shifted."""
    cut = rows.withColumns({f"_v{c}": v for c, v in values.items()}).withColumn("_b", F.expr(f"{place} div {SPAN}"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_b").agg(*[F.sum(f"_v{c}").alias(f"_t{c}") for c in values])
    sums = sums.select(F.col("_b").alias("_q"), *[F.coalesce(F.sum(f"_t{c}").over(earlier), F.lit(0)).alias(f"_t{c}") for c in values])
    inside = Window.partitionBy("_b").orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumns({f"_s{c}": F.coalesce(F.sum(f"_v{c}").over(inside), F.lit(0)) for c in values})
    return cut.join(sums, F.col("_b") == F.col("_q")).select(*rows.columns, *[(F.col(f"_s{c}") + F.col(f"_t{c}")).alias(c) for c in values])


def latest_before(asks: DataFrame, filed: DataFrame, by: list[str], place: str, values: dict[str, Column]) -> DataFrame:
    """``asks`` with the greatest of each of ``values`` (of ``filed``'s columns) among the filed rows of the same key that stand
    at smaller places. A key's rows are cut into spans of SPAN places, so no key is one task; null keys have none."""
    events = filed.select(*by, F.col(place).alias("_at"), *[v.alias(c) for c, v in values.items()])
    probes = asks.select(*by, F.col(place).alias("_at"), F.struct(*asks.columns).alias("_ask"))
    both = probes.unionByName(events, allowMissingColumns=True).withColumn("_b", F.expr(f"_at div {SPAN}"))
    inside = Window.partitionBy(*by, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy(*by, "_b").agg(*[F.max(c).alias(c) for c in values])
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*[F.col(k).alias(f"_k{k}") for k in by], F.col("_b").alias("_q"), *[F.max(c).over(earlier).alias(f"_e{c}") for c in values])
    found = both.withColumns({f"_i{c}": F.max(c).over(inside) for c in values}).where("_ask IS NOT NULL")
    same = [F.col(k) == F.col(f"_k{k}") for k in by]
    found = found.join(spans, [*same, F.col("_b") == F.col("_q")], "left")
    return found.select("_ask.*", *[F.greatest(f"_i{c}", f"_e{c}").alias(c) for c in values])
