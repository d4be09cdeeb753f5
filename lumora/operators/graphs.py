"""Connected components of an edge list of any size, by star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators.order import checkpointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component) of every end of ``edges`` (a, b, of one type that has an order): the least vertex that it reaches.

    In turns each vertex hands its larger neighbours, then its smaller ones, to the least vertex around it, until
    nothing changes. A round is two grouped minima and joins and ends in a checkpoint. Edges with a null end are left out;
    an edge from a vertex to itself keeps it.
    """
    down = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("to")).distinct()
    down, before = checkpointed(down), None
    for _ in range(max_rounds):
        both = down.unionByName(down.select(F.col("to").alias("v"), F.col("v").alias("to")))
        least = both.groupBy("v").agg(F.least(F.min("to"), F.first("v")).alias("m")).select(F.col("v").alias("_v"), "m")
        larger = both.where("to > v").join(least, F.col("v") == F.col("_v")).select(F.col("to").alias("v"), F.col("m").alias("to"))
        handed = larger.unionByName(least.select(F.col("_v").alias("v"), F.col("m").alias("to"))).distinct()
        least = handed.groupBy("v").agg(F.min("to").alias("m")).select(F.col("v").alias("_v"), "m")
        smaller = handed.join(least, F.col("v") == F.col("_v")).select(F.col("to").alias("v"), F.col("m").alias("to"))
        down = checkpointed(smaller.unionByName(least.select(F.col("_v").alias("v"), F.col("m").alias("to"))).distinct())
        now = down.agg(F.count("*"), F.sum(F.xxhash64("v", "to").cast("decimal(38,0)"))).first()
        if now == before:
            return down.groupBy("v").agg(F.min("to").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
