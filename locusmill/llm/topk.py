"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds on the rest.

Shards are ranges of length, the longest vectors first. Each is prepared once: sorted by length and rotated into the basis of its own
singular vectors, where the first few coordinates carry most of an inner product. Queries meet the longest vectors first and take
their k-th best score from there to all other shards. Block by block, from the longest vectors down, a candidate's exact
product is only computed if the partial sum plus |rest of query| * |rest of candidate| can still reach the query's
k-th best; a query ends when |query| * |candidate| can't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm._tables import dropped, written
from locusmill.llm._words import lean
from locusmill.llm.vectors import SHARD, beside, best, by_shard, matrix, queries_of, ranked, to_shards, valid

EXACT = float(1 << 53)
DENSE = 16  # products of pairs one by one cost about as much as this many in a matrix product


def _exact(q: np.ndarray, v: np.ndarray) -> bool:
    """Whether every inner product of rows of q and v, all whole numbers, and every part of its sum are exact in doubles."""
    return float(np.abs(q).max(initial=0)) / EXACT * float(np.abs(v).max(initial=0)) * q.shape[1] < 1


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products of integers held as doubles, as int64; beyond 2^53 in Python integers, held to the range of long."""
    if not len(a):
        return np.empty(0, np.int64)
    if _exact(a, b):
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    out = [sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a, b)]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in out], np.int64)


def _reaching(q: np.ndarray, v: np.ndarray, may: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, candidate and exact score of the pairs marked in may, without those below the query's kth or below k others of the same query here.

    Where many pairs are marked their products are one matrix product, which is exact below 2^53 in whatever order it is summed."""
    rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if DENSE * np.count_nonzero(may) >= len(rows) * len(cols) > 0 and _exact(q[rows], v[cols]):
        score = q[rows] @ v[cols].T
        score[~may[np.ix_(rows, cols)]] = -np.inf
        least = kth[rows].copy()
        loose = np.flatnonzero(np.isneginf(least))
        if len(loose) and len(cols) > k:
            least[loose] = np.partition(score[loose], len(cols) - k, axis=1)[:, len(cols) - k]
        i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        yield rows[i], cols[j], score[i, j].astype(np.int64)
        return
    i, j = np.nonzero(may)
    for c in range(0, len(i), 1 << 16):
        x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
        score = _products(q[x], v[y])
        keep = score >= kth[x]
        yield x[keep], y[keep], score[keep]


class Prepared:
    """A shard's vectors by descending length, in units of the largest component, with the rotated first coordinates and the length of the rest."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, head: int = 16):
        self.unit = float(np.abs(v).max(initial=0)) or 1.0
        length = np.linalg.norm(v / self.unit, axis=1)
        order = np.lexsort((ids, -length))
        self.ids, self.v, self.length = ids[order], v[order], length[order]
        small = self.v / self.unit
        self.head = min(head, v.shape[1])
        self.basis = np.linalg.eigh(small.T @ small)[1][:, ::-1]
        turned = small @ self.basis
        self.first, self.rest = turned[:, : self.head].copy(), np.linalg.norm(turned[:, self.head :], axis=1)


def search(q_ids: np.ndarray, q: np.ndarray, p: Prepared, k: int, kth: np.ndarray | None = None, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact k best candidates of each query that reach kth (its k-th best score elsewhere): query's place, candidate's id, score. All hold whole numbers."""
    unit = float(np.abs(q).max(initial=0)) or 1.0
    turned = (q / unit) @ p.basis
    first, rest = turned[:, : p.head], np.linalg.norm(turned[:, p.head :], axis=1)
    q_len = np.linalg.norm(q / unit, axis=1)
    got_q, got_id, got_score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    floor = np.full(len(q), -np.inf) if kth is None else kth
    kth = floor.copy()
    open_ = np.arange(len(q))
    slack = 1e-9  # of |query| * |candidate|, far above rounding in the rotation
    for a in range(0, len(p.ids), block):
        least = kth / unit / p.unit
        open_ = open_[q_len[open_] * p.length[a] * (1 + slack) >= least[open_]]
        if not len(open_):
            break
        at = slice(a, min(a + block, len(p.ids)))
        bound = first[open_] @ p.first[at].T + rest[open_][:, None] * p.rest[at][None]
        bound += slack * q_len[open_][:, None] * p.length[at][None]
        may = (bound >= least[open_][:, None]) & (q_ids[open_][:, None] != p.ids[at][None])
        for x, y, score in _reaching(q[open_], p.v[at], may, kth[open_], k):
            got_q, got_id, got_score = np.r_[got_q, open_[x]], np.r_[got_id, p.ids[at][y]], np.r_[got_score, score]
            stay = best(got_q, got_id, got_score, k)
            got_q, got_id, got_score = got_q[stay], got_id[stay], got_score[stay]
            full = np.bincount(got_q, minlength=len(q)) >= k
            low = np.full(len(q), np.inf)
            np.minimum.at(low, got_q, got_score)
            low -= np.abs(low) * 1e-15  # scores beyond 2^53 are rounded here
            kth = np.maximum(floor, np.where(full, low, -np.inf))
    return got_q, got_id, got_score


INDEX = "dim int, shard int, place int, vec_id long, v array<double>"


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every` the k highest integer inner products.

    Components become floor(scale * x), x as double. Candidates: every vector with another vec_id and as many components; all of them if
    fewer than k. Ties go to the smaller vec_id. Rows with a null id, a null vector, an empty one, or null or non-finite
    components take no part. A row repeated exactly counts once; vectors that share a vec_id are candidates each (the
    better one may fill two ranks), and the query is the smallest of them. Scores beyond a long are held at its ends. An empty table gives no rows.
    Other columns are not looked at, whatever their names. Candidates are dealt into shards by range of length (of ties, by vec_id), evenly whatever the vectors.
    """
    vectors = valid(embeddings, vec_id, embedding).select("vec_id", F.transform("v", lambda x: _floor(x * scale)).alias("v")).distinct()
    vectors = written(vectors.withColumn("dim", F.size("v")), "vectors")
    shards = max(1, math.ceil(vectors.count() / shard))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / 2.0**512) * (x / 2.0**512))  # in units in which squares don't overflow
    size = F.when(top < 2.0**400, F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).otherwise(size * 2.0**960)
    laid = vectors.withColumn("__size", -size).repartitionByRange(shards, "dim", "__size", "vec_id").withColumn("shard", F.spark_partition_id()).drop("__size")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shard's rows by descending length; what search needs besides is made again where a shard is loaded."""
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        for dim in np.unique(t.column("dim").to_numpy()):
            some = t.filter(pa.compute.equal(t.column("dim"), int(dim)))
            v, ids = matrix(some.column("v"), int(dim)), some.column("vec_id").to_numpy()
            order = np.lexsort((ids, -np.linalg.norm(v / (np.abs(v).max(initial=0) or 1.0), axis=1)))
            some = some.take(pa.array(order))
            yield from pa.table({"dim": some.column("dim"), "shard": some.column("shard"), "place": pa.array(np.arange(len(some)), pa.int32()), "vec_id": some.column("vec_id"), "v": some.column("v")}).combine_chunks().to_batches()

    index = written(laid.select("dim", "shard", "vec_id", "v").mapInArrow(lean(numbered), INDEX), "shards")
    places = index.groupBy("dim", "shard").agg(F.count(F.lit(1)).alias("n"))
    longest = places.groupBy("dim").agg(F.min("shard").alias("shard"))
    queries = queries_of(vectors, every)

    def load(rows: pa.Table, dim: int) -> Prepared:
        return Prepared(rows.column("vec_id").to_numpy(), matrix(rows.column("v"), dim))

    def ask(p: Prepared, rows: pa.Table) -> pa.RecordBatch:
        q_ids, kth = rows.column("vec_id").to_numpy(), rows.column("kth")
        least = None if kth.null_count == len(kth) else np.array([-np.inf if x is None else float(x) - abs(x) * 1e-15 for x in kth.to_pylist()])
        x, y, s = search(q_ids, matrix(rows.column("v"), p.v.shape[1]), p, k, least)
        return pa.RecordBatch.from_arrays([pa.array(q_ids[x]), pa.array(y), pa.array(s)], names=["query_id", "vec_id", "score"])

    kind = "query_id long, vec_id long, score long"
    first_shards = index.join(F.broadcast(longest), ["dim", "shard"], "left_semi")
    first = written(beside(first_shards, to_shards(queries, longest).withColumn("kth", F.lit(None).cast("long"))).mapInArrow(lean(by_shard(load, ask)), kind), "longest")
    full = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_id", "kth")
    others = places.join(F.broadcast(longest), ["dim", "shard"], "left_anti")
    asked = to_shards(queries.join(full, F.col("vec_id") == F.col("query_id"), "left").drop("query_id"), others)
    rest = beside(index.join(F.broadcast(longest), ["dim", "shard"], "left_anti"), asked).mapInArrow(lean(by_shard(load, ask)), kind)
    out = written(ranked(first.union(rest), k), "ranks")
    dropped(vectors, index, first)
    return out


def _floor(x):
    """floor() to a double, also beyond the range of long."""
    held = F.greatest(F.least(x, F.lit(1.7e308)), F.lit(-1.7e308))
    return F.when(F.abs(x) < F.lit(EXACT), F.floor(F.when(F.abs(x) < F.lit(EXACT), x).otherwise(0.0)).cast("double")).otherwise(held)


SQL = """
WITH e AS (SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v::DOUBLE[], e.v::DOUBLE[])::BIGINT AS score FROM q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
