"""Relational operators over the catalogue: listing, counting, lookups, merges of snapshots."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alive(videos: DataFrame) -> DataFrame:
    """Videos that are not soft-deleted; every read starts here."""
    return videos.where(~F.coalesce(F.col("deleted"), F.lit(False)))


def matching(videos: DataFrame, status: str | None = None, q: str | None = None) -> DataFrame:
    """Alive videos of a status ("all" or empty: any) whose title or author contains ``q``, case aside; its % and _
    are wildcards."""
    rows = alive(videos)
    if status and status != "all":
        rows = rows.where(F.col("status") == status)
    if q:
        rows = rows.where(F.col("title").ilike(f"%{q}%") | F.col("author").ilike(f"%{q}%"))
    return rows


def page(rows: DataFrame, order: list[Column], number: int = 1, limit: int = 50) -> DataFrame:
    """A page of 1 to 200 rows in a total order."""
    if not 1 <= limit <= 200 or number < 1:
        raise ValueError("limit must be 1 to 200 and the page 1 or more")
    return rows.orderBy(*order).offset((number - 1) * limit).limit(limit)


def counts_with_zeros(rows: DataFrame, key: str, domain: Iterable[str], total: str = "all") -> DataFrame:
    """(key, n): count per value of ``domain``, zeros included, values outside it too, and their total, which leaves
    those outside aside."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(v,) for v in domain], f"{key} string")
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    every = known.withColumn("known", F.lit(True)).join(counted, key, "full").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("known", F.lit(False)).alias("known"))
    whole = every.where("known").agg(F.lit(total).alias(key), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    return every.select(key, "n").unionByName(whole)


def queue_counts(videos: DataFrame) -> DataFrame:
    """One row: active and pending videos."""
    return alive(videos).agg(F.count_if(F.col("status") == "running").alias("active"), F.count_if(F.col("status") == "queued").alias("pending"))


def picked(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``ids`` (pos, id) with the rows they name, in their order; ``found`` says whether there is one."""
    return ids.join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_of_each(rows: DataFrame, key: list[str], order: list[Column], where: Column | None = None) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return (rows.where(where) if where is not None else rows).withColumn("_r", place).where("_r = 1").drop("_r")


def missing(names: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Names that ``known`` lacks, once each."""
    return names.select(key).distinct().join(known, key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_old: Column | None = None) -> DataFrame:
    """The snapshot after writing ``new`` over ``old`` by key; rows of ``old`` where ``keep_old`` holds stay."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("_o"), (F.coalesce(keep_old, F.lit(False)) if keep_old is not None else F.lit(False)).alias("_keep"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    row = F.when(F.col("_n").isNull() | F.coalesce("_keep", F.lit(False)), F.coalesce("_o", "_n")).otherwise(F.col("_n"))
    return o.join(n, keys, "full").select(*keys, row.alias("_r")).select(*keys, "_r.*")


def defaults_cleared(presets: DataFrame, keep_id: int) -> DataFrame:
    """The presets with no default of the kept one's kind but itself."""
    kind = presets.where(F.col("id") == keep_id).select(F.col("kind").alias("_k"))
    same = presets.join(F.broadcast(kind), presets["kind"] == kind["_k"], "left")  # one row
    return same.withColumn("is_default", F.when(F.col("_k").isNotNull(), F.col("id") == keep_id).otherwise(F.col("is_default"))).drop("_k")


def envelope(rows: DataFrame, order: list[Column], number: int, limit: int) -> dict:
    """{items, total, page, limit} of a page, for a caller outside Spark."""
    return {"items": [r.asDict() for r in page(rows, order, number, limit).collect()], "total": rows.count(), "page": number, "limit": limit}
