"""Embedding near-duplicates: randomised-rotation binary codes decide which pairs are computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import checkpointed, read
from lumora.llm.graph import components

#: Vectors that a block holds on either side, and rows of it that are compared at a time.
BLOCK, ROWS = 2048, 256


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, number: int, seed: int = 5) -> np.ndarray:
    """The ``number``-th random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(codes, factors) of unit vectors: the signs of the rotated vector, packed eight to a byte, and its inner product
    with them, normed."""
    r = x @ rotation(x.shape[1], number).T
    return np.packbits(r >= 0, axis=1), np.abs(r).sum(1) / math.sqrt(x.shape[1])


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """Packed codes as unit vectors."""
    return np.where(np.unpackbits(codes, axis=1, count=dim), np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dim))


def quantised(x: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scales, errors): the rotated vectors in signed bytes, their scale, and the length of what that leaves."""
    r = x @ rotation(x.shape[1], number).T
    scale = np.abs(r).max(1) / 127
    q = np.rint(r / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(r - q * scale[:, None], axis=1)


def bound(factor: np.ndarray, dim: int, threshold: float, failure: float = 1e-6) -> np.ndarray:
    """The least estimate of a vector whose inner product with the coded one is ``threshold`` or more.

    With factor f and inner product c the estimate errs by sqrt(1 - c^2) sqrt(1 - f^2) / f t, where t is the inner
    product of two directions that the random rotation makes independent: |t| <= 1 always, and it exceeds
    epsilon / sqrt(dim - 1) with probability at most 2 exp(-epsilon^2 / 2). epsilon is set so that this is
    ``failure`` for a pair at the threshold; more similar pairs fail less. 0 takes t = 1, with which no pair is lost.
    """
    t = min(1.0, math.sqrt(2 * math.log(2 / failure) / max(dim - 1, 1))) if failure > 0 else 1.0
    return threshold - math.sqrt(max(0.0, 1 - threshold * threshold)) * np.sqrt(np.maximum(0, 1 - factor * factor)) / factor * t


def tables_for(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables): buckets of some BLOCK / 2 vectors, and so many tables that a pair at the threshold meets in
    none of them with a probability of at most ``miss``."""
    bits = min(30, max(1, math.ceil(math.log2(max(n, 2) / (BLOCK / 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


CODED = "id long, copies long, dim int, code binary, factor float, q binary, scale float, err float, keys binary"


def _coded(bits: int, tables: int):
    """All that a pair is estimated and filed by, computed once per vector: (CODED, v, buckets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, own in b.groupby(b["v"].map(len), sort=False):
                x = units(own["v"].tolist())
                per = max(1, dim // bits)  # tables that one rotation serves
                powers = 1 << np.arange(min(bits, dim), dtype=np.int32)
                keys = np.empty((len(x), tables), np.int32)
                for r in range(-(-tables // per)):
                    above = (x @ rotation(dim, r + 1).T) >= 0
                    for k in range(per):
                        if (t := r * per + k) < tables:
                            own_bits = above[:, k * bits : (k + 1) * bits]
                            keys[:, t] = own_bits @ powers[: own_bits.shape[1]]
                code, factor = encode(x)
                q, scale, err = quantised(x)
                small = keys.astype(np.int16 if bits < 16 else np.int32)
                yield pd.DataFrame({
                    "id": own["id"].to_numpy(), "copies": own["copies"].to_numpy(), "dim": dim, "code": [c.tobytes() for c in code], "factor": factor.astype(np.float32),
                    "q": [c.tobytes() for c in q], "scale": scale.astype(np.float32), "err": err.astype(np.float32), "keys": [k.tobytes() for k in small], "v": own["v"].to_numpy(), "buckets": list(keys),
                })

    return run


def _bytes(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _undecided(left: pd.DataFrame, right: pd.DataFrame, same: bool, table: int, dim: int, wide: type, threshold: float, failure: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of pairs that the codes do not rule out and that no earlier table holds together."""
    codes, factor = signs(_bytes(right["code"], np.uint8), dim), right["factor"].to_numpy()
    q = _bytes(left["q"], np.int8).astype(np.float32) * left["scale"].to_numpy()[:, None]
    err = left["err"].to_numpy()
    least = (bound(factor.astype(float), dim, threshold, failure) - 1e-5).astype(np.float32)
    ka, kb = _bytes(left["keys"], wide)[:, :table], _bytes(right["keys"], wide)[:, :table]
    for at in range(0, len(left), ROWS):
        part = slice(at, at + ROWS)
        open_ = (q[part] @ codes.T + err[part, None]) / factor >= least
        if 16 * np.count_nonzero(open_) > open_.size:  # many copies of each other
            for t in range(table):
                open_ &= ka[part, t][:, None] != kb[None, :, t]
            a, c = np.nonzero(open_)
        else:
            a, c = np.nonzero(open_)
            new = ~(ka[a + at] == kb[c]).any(1)
            a, c = a[new], c[new]
        if same:
            a, c = a[a + at < c], c[a + at < c]
        if len(a):
            yield a + at, c


def _sides(b: pd.DataFrame, i: int, j: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    b = b.sort_values("id")
    return (b, b) if i == j else (b[b["part"] == i], b[b["part"] == j])


def _touched(wide: type, threshold: float, failure: float):
    """(tab, bucket, i, j, dim, id, part) of the vectors of a block that are in an undecided pair."""

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        table, bucket, i, j, dim = key
        left, right = _sides(b, i, j)
        hit_l, hit_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
        if len(left) and len(right):
            for a, c in _undecided(left, right, i == j, table, dim, wide, threshold, failure):
                hit_l[a] = True
                hit_r[c] = True
        rows = [(left, hit_l | hit_r)] if i == j else [(left, hit_l), (right, hit_r)]
        out = pd.concat([side.loc[hit, ["id", "part"]] for side, hit in rows])
        return out.assign(tab=table, bucket=bucket, i=i, j=j, dim=dim)[["tab", "bucket", "i", "j", "dim", "id", "part"]]

    return run


def _compared(wide: type, threshold: float, failure: float):
    """Of a block's touched vectors: (id, links, root, exact) for each that has links or exact computations; root is the
    smallest id joined to it by any link of the block, exact the number of pairs computed with it as the left one."""

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        table, _, i, j, dim = key
        left, right = _sides(b, i, j)
        x = units(left["v"].tolist()) if len(left) else np.zeros((0, dim))
        y = x if i == j else units(right["v"].tolist()) if len(right) else np.zeros((0, dim))
        ca, cb = left["copies"].to_numpy(), right["copies"].to_numpy()
        ids = left["id"].to_numpy() if i == j else np.concatenate((left["id"].to_numpy(), right["id"].to_numpy()))
        shift = 0 if i == j else len(left)
        links, exact, pairs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), []
        for a, c in _undecided(left, right, i == j, table, dim, wide, threshold, failure) if len(x) and len(y) else ():
            near = np.concatenate([np.einsum("ij,ij->i", x[a[s : s + 65536]], y[c[s : s + 65536]]) for s in range(0, len(a), 65536)]) >= threshold
            np.add.at(exact, a, 1)
            a, c = a[near], c[near]
            np.add.at(links, a, cb[c])
            np.add.at(links, c + shift, ca[a])
            pairs.append((a, c + shift))
        a, c = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        root = ids.copy()
        while True:
            low = np.minimum(root[a], root[c])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, c, low)
            if (new == root).all():
                break
            root = new
        kept = (links > 0) | (exact > 0)
        return pd.DataFrame({"id": ids[kept], "links": links[kept], "root": root[kept], "exact": exact[kept]})

    return run


def linked(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-6, failure: float = 1e-6) -> DataFrame:
    """(id, links, component, exact) of the vectors of ``vectors`` (id, v, copies: distinct usable ones, each with an id of its own)
    that have links; exact counts the pairs computed exactly.

    Vectors are filed under the signs of random rotations in several tables. In a bucket, inner products are estimated
    from stored codes and factors; only pairs whose confidence bound reaches the threshold, in the first table
    that holds them together, are computed exactly in double precision, and only their vectors are fetched for that.
    Buckets beyond BLOCK vectors are cut into parts and each two parts meet in a task of their own, so no task holds
    more than two parts. What leaves a block is a row per vector, not per pair. Vectors of different lengths do not
    link. A pair at the threshold is lost with probability at most ``miss`` + ``failure``.
    """
    n = vectors.count()
    bits, tables = tables_for(n, threshold, miss)
    wide = np.int16 if bits < 16 else np.int32
    coded = checkpointed(vectors.select("id", "v", "copies").mapInPandas(_coded(bits, tables), f"{CODED}, v array<double>, buckets array<int>"))
    stored = [c.split()[0] for c in CODED.split(", ")]
    rows = coded.select(*stored, F.posexplode("buckets").alias("tab", "bucket"))
    sizes = coded.select("dim", F.posexplode("buckets").alias("tab", "bucket")).groupBy("tab", "bucket", "dim").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(F.col("tab").alias("_t"), F.col("bucket").alias("_b"), F.col("dim").alias("_d"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    # some 2 n tables / BLOCK rows
    own = rows.join(F.broadcast(sizes) if n * tables < 1 << 28 else sizes, (F.col("tab") == F.col("_t")) & (F.col("bucket") == F.col("_b")) & (F.col("dim") == F.col("_d"))).drop("_t", "_b", "_d")
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    own = own.withColumn("o", F.explode(other)).withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o")).drop("o", "parts")
    block = ["tab", "bucket", "i", "j", "dim"]
    touched = checkpointed(own.groupBy(*block).applyInPandas(_touched(wide, threshold, failure), "tab int, bucket int, i int, j int, dim int, id long, part int"))
    whole = touched.join(coded.select(*[c for c in stored if c != "dim"], "v"), "id")
    found = checkpointed(whole.groupBy(*block).applyInPandas(_compared(wide, threshold, failure), "id long, links long, root long, exact long"))
    roots = components(found.where("links > 0").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("exact").alias("exact"))
    return counts.join(roots, counts["id"] == roots["v"], "left").select("id", "links", F.coalesce("component", "id").alias("component"), "exact")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept, n_exact) per row of ``table``; n_exact, for cost reports, counts the pairs
    that were computed exactly with the row's vector as the left one.

    Rows whose vector is null, empty, zero or holds null or non-finite components link with nothing: 0 links, a
    component of their own. Every row is a vector of its own, also where rows share an id: equal vectors are compared
    once and counted as often as they occur, and different vectors of one id have their own links and components. The
    component is named by the smallest id in it; a null id links like others but names no component. An empty table
    gives no row.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")), F.col("v")))
    distinct = checkpointed(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    distinct = checkpointed(distinct.withColumn("id", F.monotonically_increasing_id()))
    found = linked(distinct, **options).withColumnRenamed("id", "_i")
    told = distinct.join(found, distinct["id"] == found["_i"], "left").withColumn("component", F.coalesce("component", "id"))
    names = told.groupBy(F.col("component").alias("_c")).agg(F.min("least").alias("name"))
    classes = told.join(names, F.col("component") == F.col("_c")).select(
        F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "name", F.coalesce("exact", F.lit(0)).alias("exact")
    )
    out = rows.join(classes, rows["v"] == classes["_v"], "left")
    component = F.when(F.col("_v").isNull(), F.col("vec_id")).otherwise(F.col("name"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.coalesce("exact", F.lit(0)).cast("long").alias("n_exact"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
