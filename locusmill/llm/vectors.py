"""What both vector searches share: which vectors take part, and dealing queries and candidates out in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 16384  # candidates searched at once


def valid(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Distinct (vec_id, v) with neither null, at least one component, and all components finite numbers; v is array<double>."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    v = embeddings[embedding].cast("array<double>")
    return embeddings.select(embeddings[vec_id].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine)).distinct()


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    """One vector for each vec_id divisible by `every`: where an id has several, the smallest in array order."""
    return vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def beside(index: DataFrame, queries: DataFrame) -> DataFrame:
    """index (with columns dim, shard, place) and queries (dim, shard) in one table, each shard's index rows followed by its queries: kind 0 and 1.

    A stated set of queries goes against all rows, shard by shard: the index is moved once, no pair of rows is made by a join, and a task holds one
    shard and streams the queries past it."""
    both = index.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(F.col("dim"), F.col("shard")).sortWithinPartitions("dim", "shard", "kind", "place")


def to_shards(queries: DataFrame, shards: DataFrame) -> DataFrame:
    """Each query (vec_id, v) for each shard (dim, shard: a row for every SHARD vectors) of vectors with as many components."""
    per = shards.groupBy("dim").agg(F.collect_list("shard").alias("__to"))
    return queries.withColumn("dim", F.size("v")).join(F.broadcast(per), "dim").withColumn("shard", F.explode("__to")).drop("__to")


def by_shard(load: Callable[[pa.Table, int], object], ask: Callable[[object, pa.Table], pa.RecordBatch | None], at_once: int = 512):
    """For mapInArrow over beside(): load(rows of a shard, dim) once, then ask(what load gave, queries) for `at_once` queries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, held, loaded = None, [], [], None

        def asked(all_: bool):
            nonlocal held, loaded
            if not held or not index and loaded is None:
                held = held if index or loaded is not None else []
                return
            if loaded is None:
                loaded = load(pa.Table.from_batches(index).combine_chunks(), key[0])
                index.clear()
            rows = pa.Table.from_batches(held).combine_chunks()
            upto = len(rows) if all_ else len(rows) // at_once * at_once
            for a in range(0, upto, at_once):
                if (out := ask(loaded, rows.slice(a, min(at_once, upto - a)))) is not None and len(out):
                    yield out
            held = rows.slice(upto).combine_chunks().to_batches() if upto < len(rows) else []

        for batch in batches:
            if not len(batch):
                continue
            k = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")], 1)
            cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
            for a, b in zip(cuts, np.r_[cuts[1:], len(k)]):
                if (now := (int(k[a, 0]), int(k[a, 1]))) != key:
                    yield from asked(True)
                    key, index, held, loaded = now, [], [], None
                (held if k[a, 2] else index).append(batch.slice(a, b - a))
                if sum(map(len, held)) >= at_once:
                    yield from asked(False)
        yield from asked(True)

    return run


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column whose rows all have `dim` numbers as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best for each query: highest score first, ties to the smaller id."""
    order = np.lexsort((ids, ~score if score.dtype.kind == "i" else -score, q))  # ~ has no overflow
    first = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of all shards for each query (k rows a shard come in; adaptive joins or hot groups don't arise)."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
