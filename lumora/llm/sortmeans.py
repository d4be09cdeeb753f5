"""Centroid clustering of integer vectors by sort-means: exact nearest centroids with few distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import checkpointed, read

#: Largest size of a component: squared distances of 64 components then fit into a bigint.
LARGEST = 1 << 27
#: Vectors whose distances are computed at a time.
ROWS = 8192


def assign(x: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each integer vector: the nearest centroid, ties to the smaller number.

    The other centroids are sorted by their distance from each centroid. A vector starts at the centroid that it had
    ``before`` and looks at the others in that order, until one lies strictly beyond twice its distance from where it started:
    by the triangle inequality that one and all after it are strictly farther than the start.
    """
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(between, axis=1, kind="stable")
    cluster, nearest = before.copy(), np.empty(len(x), np.int64)
    for start in np.unique(before):
        at = np.flatnonzero(before == start)
        own = ((x[at] - centroids[start]) ** 2).sum(1)
        best, number = own.copy(), np.full(len(at), start)
        left = np.arange(len(at))
        for other in order[start]:
            if other == start:
                continue
            # squared, so twice the distance is four times; at that very distance the other may tie and have a smaller number
            left = left[between[start, other] <= 4 * own[left]]
            if not len(left):
                break
            d = ((x[at[left]] - centroids[other]) ** 2).sum(1)
            nearer = (d < best[left]) | ((d == best[left]) & (other < number[left]))
            best[left[nearer]], number[left[nearer]] = d[nearer], other
        cluster[at], nearest[at] = number, best
    return cluster, nearest


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` (id, v, cluster) with the cluster of these centroids, starting from the one that they have, and its ``distance``."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
                cluster, distance = assign(x, centroids, b.column("cluster").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    return rows.select("id", "v", "cluster").mapInArrow(run, "id long, v array<int>, cluster int, distance long")


def integers(v: Column, dim: int = 64, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as an array of ints; null unless there are ``dim`` components, all finite.

    Components beyond ``LARGEST`` count as that, since squared distances would not fit into a bigint.
    """
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale))).cast("int"))
    return F.when((F.size(v) == dim) & whole, held)


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<id>``; equal ids by their components, null ids last."""
    tag = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r["v"] for r in rows.select(tag.alias("tag"), "v").orderBy(F.asc_nulls_last("tag"), "v").limit(k).collect()], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors at the floor of their mean, exactly; the sums of a cluster are one row."""
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, v, cluster, distance), centroids) after ``rounds`` rounds of sort-means and a last assignment.

    ``v`` are the components as integers. Vectors that are null, have another number of components, or hold a null or a
    component that is not finite are left out; rows that repeat an id are vectors of their own; rows without an id are
    clustered and start a centroid only if too few others are left. With fewer than ``k`` vectors each starts one;
    an empty table gives an empty result. What reaches the driver are ``k`` centroids a round. Each round is one pass over
    the vectors, cut by a checkpoint, from which the next takes the assignment that it starts at.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), dim, scale).alias("v")).where("v IS NOT NULL")
    centroids = first_centroids(rows, k, seed)
    rows = rows.withColumn("cluster", F.lit(0))
    if not len(centroids):
        return rows.withColumn("distance", F.lit(0).cast("long")), centroids
    for _ in range(rounds):
        rows = checkpointed(assigned(rows, centroids))
        centroids = moved(rows, centroids)
    return checkpointed(assigned(rows, centroids)), centroids


def inertias(rows: DataFrame) -> dict[int, int]:
    """Sum of the distances of each cluster, one row a cluster."""
    return {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(read(spark, sf_dir, "embeddings"))
    by = inertias(rows)
    told = [(c, by.get(c, 0), sum(by.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    of = F.broadcast(spark.createDataFrame(told, "_c int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return rows.join(of, F.col("cluster") == F.col("_c")).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The query in DuckDB's SQL: all distances to all centroids, each round a further table."""
    parts = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
      "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY tag, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS tag, v FROM kept ORDER BY tag, v LIMIT 16))"]
    square = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i])))"
    for n in range(4):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, v, unnest(arg_min(c, (d, c), 1)) AS c, min(d) AS d FROM (SELECT k.r AS r, k.vec_id AS vec_id, k.v AS v, m.c AS c, CAST({square} AS BIGINT) AS d FROM kept k, c{n} m) GROUP BY r, vec_id, v)")
        if n < 3:
            means = f"SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY c, i) GROUP BY c"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c AS c, coalesce(s.v, o.v) AS v FROM c{n} o LEFT JOIN ({means}) s ON s.c = o.c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a3 a JOIN c3 m ON m.c = a.c"""
