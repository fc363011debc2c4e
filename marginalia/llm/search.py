"""Exact top-k search by inner product over a pivot-distance index.

Vectors are taken to whole numbers, floor(scale * x). The largest inner product is the least distance
once each vector has one more coordinate that brings all to the same length, so the triangle
inequality holds. The index keys each row by its nearest pivot and the distance to it, sorted within
tasks; a run of neighbours in that order is an annulus around a pivot. For a block of queries the
annuli around each query's own place are read first; the k-th best score there is a bound, and then
every annulus that the triangle inequality does not rule out under that bound is read.

Pivots come from a bounded sample (`sample` rows by hash); every row is indexed and the result is
exact whatever they are. Queries are taken in blocks of `block` rows, so that what is broadcast has a
fixed size.

Vectors that are null, or hold null or non-finite components, or differ in length from most, take no
part; rows with a null identifier neither. Rows that share an identifier are candidates each, save
for queries of that identifier. Ties go to smaller identifiers. Other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

PIVOTS, SAMPLE, BLOCK, RING = 48, 4096, 4096, 256


def whole(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): rows that take part, as arrays of long."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))) & F.col(key).isNotNull()
    return vectors.filter(fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, width)


def _lift(x: np.ndarray, length2: float) -> np.ndarray:
    """One more coordinate brings every vector to the same length."""
    x = x.astype(np.float64)
    return np.concatenate((x, np.sqrt(np.maximum(length2 - (x * x).sum(1), 0))[:, None]), 1)


def choose_pivots(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Far-apart rows, then a few rounds of means."""
    p = [x[0]]
    d = ((x - p[0]) ** 2).sum(1)
    while len(p) < min(n, len(x)) and d.max() > 0:
        p.append(x[int(np.argmax(d))])
        d = np.minimum(d, ((x - p[-1]) ** 2).sum(1))
    p = np.array(p)
    for _ in range(rounds):
        own = np.argmin(((p * p).sum(1)[None, :] - 2 * x @ p.T), 1)
        for j in range(len(p)):
            if (own == j).any():
                p[j] = x[own == j].mean(0)
    return p


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def build(rows: DataFrame, pivots: np.ndarray, length2: float) -> DataFrame:
    """(pivot, dist, id, v), dealt by ranges of (pivot, distance) and sorted in each task."""
    width = pivots.shape[1] - 1

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), width)
            d = _distances(_lift(x, length2), pivots)
            j = np.argmin(d, 1)
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(d[np.arange(len(j)), j]), b.column(0), b.column(1)], names=["pivot", "dist", "id", "v"])

    keyed = common.map_arrow(rows, run, "pivot int, dist double, id long, v array<long>")
    return keyed.repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, block: int = BLOCK, sample: int = SAMPLE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the largest inner product for each row whose key is divisible by `every`."""
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "search")
    rows = whole(vectors, key, vector, scale)
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score long").withColumnRenamed("id", key)
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None or not widths["w"]:
        return empty
    width = widths["w"]
    rows = rows.filter(F.size("v") == width)
    length2 = float(rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e))).first()[0])
    seen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # `sample` vectors
    p = choose_pivots(_lift(np.array([r.v for r in seen], np.int64), length2), pivots)
    index = scratch.keep(build(rows, p, length2), "index")
    queries = index.filter(F.col("id") % every == 0)
    numbered = scratch.keep(queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // block)))).alias("block")), "queries")
    found = None
    for (n,) in numbered.select("block").distinct().orderBy("block").collect():
        got = numbered.filter(F.col("block") == n).orderBy("id").collect()
        part = scratch.keep(_block(index, np.array([r.id for r in got], np.int64), np.array([r.v for r in got], np.int64), p, length2, k), f"block-{n}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _block(index: DataFrame, qid: np.ndarray, q: np.ndarray, pivots: np.ndarray, length2: float, k: int) -> DataFrame:
    spark = index.sparkSession
    width = q.shape[1]
    flat = np.concatenate((q.astype(np.float64), np.zeros((len(q), 1))), 1)  # a query's own last coordinate is 0
    to_pivot = _distances(flat, pivots)
    home = to_pivot.argmin(1)
    # where a query lies among the rows: its own place in the index, as a row
    as_row = _distances(_lift(q, length2), pivots)
    q2 = (flat * flat).sum(1)
    # what rounding can add to a distance, in proportion to the vectors' lengths
    slack = 1e-6 + 1e-7 * float(np.sqrt(q2.max(initial=0.0) + length2))
    shared = spark.sparkContext.broadcast((qid, q, to_pivot, q2, as_row.argmin(1), as_row.min(1)))  # one block of queries
    del home

    def rings(batches):
        """Annuli: runs of neighbours around one pivot, RING rows at most."""
        for b in batches:
            j = b.column(0).to_numpy()
            cut = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
            for a, e in zip(cut, np.append(cut[1:], len(j))):
                for s in range(a, e, RING):
                    t = b.slice(s, min(RING, e - s))
                    yield int(j[a]), t.column(1).to_numpy(), t.column(2).to_numpy(), matrix(t.column(3), width)

    def out(best):
        rows = [(int(qid_), i, s) for qid_, (ids, scores) in best.items() for i, s in zip(ids.tolist(), scores.tolist())]
        c = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["query_id", "id", "score"])

    def scores_of(own: np.ndarray, x: np.ndarray) -> np.ndarray:
        s = own.astype(np.float64) @ x.astype(np.float64).T
        if float(np.abs(own).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2**52:
            return np.rint(s).astype(np.int64)
        return own @ x.T

    def near(batches):
        """The best k of the annuli that hold a query's own place."""
        qid, q, _, _, home, at = shared.value
        best: dict = {}
        for j, d, ids, x in rings(batches):
            mine = np.flatnonzero((home == j) & (at >= d[0] - slack) & (at <= d[-1] + slack))
            if not len(mine):
                continue
            s = scores_of(q[mine], x)
            for r, i in enumerate(mine.tolist()):
                other = ids != qid[i]
                a, b = best.get(qid[i], (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                a, b = np.concatenate((a, ids[other])), np.concatenate((b, s[r][other]))
                t = _best(a, b, k)
                best[qid[i]] = (a[t], b[t])
        if best:
            yield out(best)

    first = common.map_arrow(index, near, "query_id long, id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("query_id", "score").collect()  # a number for each query of the block
    bound = np.full(len(qid), np.iinfo(np.int64).min // 4, np.int64)
    place = {int(i): n for n, i in enumerate(qid)}
    for r in kth:
        bound[place[r.query_id]] = r.score
    limit = spark.sparkContext.broadcast(bound)

    def rest(batches):
        """Annuli from which a score of at least the bound can come.

        |q - x|**2 = |q|**2 + length2 - 2 * score, and |q - x| >= | |q - pivot| - |x - pivot| |."""
        qid, q, to_pivot, q2, _, _ = shared.value
        low = limit.value.copy()
        radius = np.sqrt(np.maximum(q2 + length2 - 2.0 * low, 0)) + slack
        best: dict = {}
        for j, d, ids, x in rings(batches):
            dq = to_pivot[:, j]
            mine = np.flatnonzero((np.maximum(d[0] - dq, dq - d[-1])) <= radius)
            if not len(mine):
                continue
            s = scores_of(q[mine], x)
            hit = s >= low[mine][:, None]
            for r in np.flatnonzero(hit.any(1)).tolist():
                i = int(mine[r])
                keep = hit[r] & (ids != qid[i])
                if not keep.any():
                    continue
                a, b = best.get(qid[i], (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                a, b = np.concatenate((a, ids[keep])), np.concatenate((b, s[r][keep]))
                t = _best(a, b, k)
                best[qid[i]] = (a[t], b[t])
                if len(t) == k and b[t[-1]] > low[i]:
                    low[i] = b[t[-1]]
                    radius[i] = np.sqrt(max(q2[i] + length2 - 2.0 * low[i], 0)) + slack
        if best:
            yield out(best)

    return common.map_arrow(index, rest, "query_id long, id long, score long")
