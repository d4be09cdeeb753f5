"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched with a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.common import checkpointed, read
from lumora.llm.rabitq import units, usable

#: Vectors of a shard, its graph's degree, beams while building and searching, and pruning's relaxation.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 16384, 32, 48, 160, 1.2
#: Points that a search may start from.
ENTRIES = 48
#: Scores that differ by less are looked at as ties until the last ranking.
TIE = 1e-9
#: Queries that meet a shard in one task; points that are inserted together.
QUERIES, TOGETHER = 4096, 256


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the ``beam`` best points found for each query, best first; -1 fills.

    ``graph`` holds each point's out-neighbours (-1: none). A search starts from the best of ``entries``. All queries
    advance together; each step follows the edges of a query's ``at_once`` best points not followed yet, until every
    point of its beam is followed.
    """
    n, rows, at_once = len(x), np.arange(len(q))[:, None], min(at_once, beam)
    ids = np.full((len(q), beam), -1, np.int32)
    near = np.full((len(q), beam), -np.inf, np.float32)
    done = np.ones((len(q), beam), bool)
    seen = np.zeros((len(q), n + 1), bool)  # the last column takes the -1
    entries = entries[:beam]
    ids[:, : len(entries)], near[:, : len(entries)], done[:, : len(entries)], seen[:, entries] = entries, q @ x[entries].T, False, True
    live = np.arange(len(q))
    while len(live):
        r = rows[: len(live)]
        open_ = np.where(done[live], -np.inf, near[live])
        pick = np.argpartition(-open_, at_once - 1, axis=1)[:, :at_once]
        chosen = np.isfinite(np.take_along_axis(open_, pick, 1))
        if not chosen.all(axis=1).any() and not chosen.any():
            break
        src = np.where(chosen, np.take_along_axis(ids[live], pick, 1), -1)
        d = done[live]
        d[r, pick] = True
        done[live] = d
        new = np.where(src[:, :, None] >= 0, graph[src], -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        seen[live, n] = False
        hit, col = np.nonzero(new >= 0)
        got = np.full(new.shape, -np.inf, np.float32)
        got[hit, col] = np.einsum("ij,ij->i", x[new[hit, col]], q[live[hit]])
        all_ids = np.concatenate((ids[live], new.astype(np.int32)), axis=1)
        all_near = np.concatenate((near[live], got), axis=1)
        all_done = np.concatenate((done[live], np.zeros(new.shape, bool)), axis=1)
        top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        ids[live], near[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_near, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1) | ~np.isfinite(near[live])
        live = live[~done[live].all(axis=1)]
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of ``p`` at most ``degree`` of its candidates (-1: none), nearest first: one is dropped once a
    kept one is nearer to it by the factor ``alpha`` than the point itself. Distances are Euclidean."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == p[:, None]] = -1
    v = x[cand]
    dist = np.where(cand >= 0, 2 - 2 * np.einsum("ij,ikj->ik", x[p], v), np.inf)
    order = np.argsort(dist, axis=1)
    cand, dist, v = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    between = 2 - 2 * (v @ v.transpose(0, 2, 1))
    alive, out = np.isfinite(dist), np.full((len(p), degree), -1, np.int32)
    rows = np.arange(len(p))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = cand[rows, first][some]
        alive &= ~(some[:, None] & (alpha * alpha * between[rows, first] <= dist))
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over unit vectors. The entries are the point nearest the mean and ENTRIES - 1 at random.

    Points are inserted in random order, in groups of at most an eighth of what is there: a greedy search of the graph so
    far proposes a point's neighbours, pruning keeps diverse ones, and each kept one gets an edge back. A point may
    gather half as many edges again as ``degree`` before it is pruned anew.
    """
    n = len(x)
    entry = int((x @ x.mean(0)).argmax())
    if n <= degree + 1:
        full = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        np.fill_diagonal(full, -1)
        return full, np.array([entry], np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate(([np.int32(entry)], order[order != entry]))
    graph = np.full((n, degree + degree // 2), -1, np.int32)
    graph[order[: degree + 1], : degree + 1] = order[: degree + 1]
    graph[graph == np.arange(n)[:, None]] = -1
    at = degree + 1
    while at < n:
        p = order[at : at + min(TOGETHER, max(8, at // 8))]
        found, _ = beam_search(x, graph, x[p], order[: min(ENTRIES, at)], min(beam, at))
        graph[p, :degree] = robust_prune(x, p, found, degree, alpha)
        src, dst = np.repeat(p, degree), graph[p, :degree].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(to), int(count.max())), -1, np.int32)
        back[np.repeat(np.arange(len(to)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        both = np.concatenate((graph[to], back), axis=1)
        fits = (both >= 0).sum(1) <= graph.shape[1]
        graph[to[fits]] = -np.sort(-both[fits], axis=1)[:, : graph.shape[1]]
        for some in np.array_split(np.flatnonzero(~fits), -(-int((~fits).sum()) // TOGETHER) or 1):
            if len(some):
                graph[to[some]] = -1
                graph[to[some], :degree] = robust_prune(x, to[some], both[some], degree, alpha)
        at += len(p)
    return graph, order[:ENTRIES]


def direction(v: Column) -> Column:
    """The vector's direction to 12 digits, as whole numbers: the same for all positive multiples of a vector, but for the
    rare one whose rounding falls on an edge, which is a point of its own."""
    top = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    length = lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + (x / m) * (x / m)))
    scaled = F.transform(F.array(top), lambda m: F.transform(F.array(length(m)), lambda n: F.transform(v, lambda x: F.round(x / m / n * 1e12).cast("long"))))
    return F.flatten(F.flatten(scaled))


def index(points: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, pos, v, ids, near, entry): the graph of each shard of ``points`` (v, ids: one row per direction); entry
    marks the points that searches start from.

    Points are dealt by a hash of the vector to as many shards as keep them at some ``shard`` points; every point
    is indexed. Each shard is a partition, built by one task, and does not depend on others.
    """
    shards = max(1, round(points.count() / shard))
    dealt = points.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        whole = pd.concat(held) if held else pd.DataFrame({"shard": [], "v": [], "ids": []})
        for (number, _), own in whole.groupby([whole["shard"], whole["v"].map(len)]):  # vectors of another length are a graph of their own
            x = units(own["v"].tolist())
            own = own.iloc[np.lexsort(x.T)]
            graph, entries = build(units(own["v"].tolist()).astype(np.float32))
            places = np.arange(len(own))
            yield pd.DataFrame({"shard": number, "pos": places, "v": own["v"].to_numpy(), "ids": own["ids"].to_numpy(), "near": list(graph), "entry": np.isin(places, entries)})

    made = dealt.repartitionById(shards, F.col("shard")).mapInPandas(run, "shard int, pos int, v array<double>, ids array<long>, near array<int>, entry boolean")
    return checkpointed(made)


def search(made: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries`` (query_id, v), its own id aside.

    Every block of QUERIES queries is searched in every shard, each such pair in a task of its own. All points that a
    search found are scored again, by the cosine of the original vectors in double precision; a shard's ``k`` best and
    all that tie with the last of them go to one ranking per query, where ties go to the smaller id.
    """
    shards = (made.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    there = made.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for dim, own in asked.groupby(asked["v"].map(len), sort=False) if len(points) else ():
            mine = points[points["v"].map(len) == dim].sort_values("pos")
            if not len(mine):
                continue
            x, q, who = units(mine["v"].tolist()), units(own["v"].tolist()), own["query_id"].to_numpy()
            graph = np.stack(mine["near"].to_numpy())
            sizes = mine["ids"].map(len).to_numpy()
            ids, starts = np.concatenate(mine["ids"].to_numpy()), np.concatenate(([0], np.cumsum(sizes)))
            entries, flat = np.flatnonzero(mine["entry"].to_numpy()), x.astype(np.float32)
            for s in range(0, len(q), 512):
                part = slice(s, s + 512)
                found, _ = beam_search(flat, graph, q[part].astype(np.float32), entries, min(beam, len(x)))
                row, col = np.nonzero(found >= 0)
                at = found[row, col]
                score = np.einsum("ij,ij->i", q[part][row], x[at])
                n = sizes[at]  # each point stands for all its ids
                row, score = np.repeat(row, n), np.repeat(score, n)
                vec = ids[np.repeat(starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                other = vec != who[part][row]
                row, score, vec = row[other], score[other], vec[other]
                by = np.lexsort((vec, -score, row))
                row, score, vec = row[by], score[by], vec[by]
                first = np.searchsorted(row, np.arange(len(q[part]) + 1))
                last = np.minimum(first[:-1] + k - 1, first[1:] - 1)
                kept = score >= score[np.maximum(last, 0)][row] - TIE if len(row) else np.zeros(0, bool)
                out.append(pd.DataFrame({"query_id": who[part][row[kept]], "vec_id": vec[kept], "score": score[kept]}))
        return pd.concat(out)

    pairs = asked.groupBy("shard", "block").cogroup(there.groupBy("shard", "block"))
    found = pairs.applyInPandas(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id may have several vectors
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each usable row whose id is divisible by ``every``, among all other usable rows.

    Null ids take no part. Positive multiples of a vector are one point of the graph, with the smallest k + 1 of its
    ids: the others cannot be among a query's k nearest, as ties go to smaller ids. Rows that repeat an id with the
    same vector are one candidate; with different vectors, an id may answer for each and counts once, by the best. An
    empty table or a lone vector gives no row.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    few = rows.withColumn("d", direction(F.col("v"))).groupBy("d", "id").agg(F.min("v").alias("v"))
    first = F.row_number().over(Window.partitionBy("d").orderBy("id"))
    few = few.withColumn("r", first).where(F.col("r") <= k + 1)
    points = checkpointed(few.groupBy("d").agg(F.min_by("v", "id").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids"))
    queries = checkpointed(rows.where(F.col("id") % every == 0).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("v")))
    return search(index(points), queries, k)


def op10_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
