"""Connected components of an edge list as repeated star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import checkpointed, narrowed, settled


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component) for each vertex of ``edges`` (a, b: bigint); component is the smallest vertex reachable.

    Alternates large-star and small-star steps until the edge set no longer changes; each round is a grouped
    minimum and a join on the vertex, and ends in a checkpoint, so a lost executor repeats one round at most.
    Stages have as many tasks as their rows are worth, so that the files of a round's shuffles do not hang on the
    session's number of partitions. Self loops keep their vertex. Null ends are ignored.
    """
    stars, rows = settled(
        edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(max_rounds if rows else 0):
        both = narrowed(stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * rows)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = narrowed(large.union(low.select("u", F.col("m").alias("v"))), 2 * rows)
        down = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = narrowed(small.union(down.select("u", F.col("m").alias("v"))), 2 * rows).distinct()
        stars = checkpointed(narrowed(found, 2 * rows))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rows = now[0]
        if now == seen:
            break
        seen = now
    else:
        if rows:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return narrowed(stars.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "v"), rows)
