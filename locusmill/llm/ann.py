"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Distinct vectors are dealt into shards by their content. In a shard the graph is a set of flat neighbour arrays, one row of a
fixed width for each node and layer. Layers are built from the highest down. Nodes come in in batches: each searches the graph of those that
are in already, from where the layers above lead it, and is linked to the nearest ones found and in its batch; lists are
thinned by the usual rule: a neighbour stays if it is nearer to the node than to any neighbour kept before.
Inner products become distances by one more component, sqrt(longest^2 - |v|^2), which makes all vectors equally long.
Queries walk down the layers and search the lowest one with a beam, many at a time; shards' results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusmill.llm._tables import dropped, written
from locusmill.llm._words import lean
from locusmill.llm.vectors import SHARD, beside, best, by_shard, matrix, queries_of, ranked, to_shards, valid

M = 16
BEAM = 128
LONGEST = 32  # longest vectors, which most queries are near to by inner product and few nodes by distance: the lowest layer is entered there too
POOL = 48  # beam by which a new node's neighbours are searched
BESIDE = 16  # nearest ones of its own batch that are looked at besides
BATCH, AT_ONCE = 2048, 512  # new nodes linked together, and searched for together


def scaled(v: np.ndarray) -> np.ndarray:
    """v in units of its largest component: squares neither overflow nor, as 32-bit floats, leave their range."""
    return v / (float(np.abs(v).max(initial=0)) or 1.0)


def lifted(v: np.ndarray) -> np.ndarray:
    """v with one more component, in doubles: distances are far smaller than the common length where a vector is much longer than others."""
    square = np.einsum("ij,ij->i", v, v)
    return np.c_[v, np.sqrt(np.maximum(square.max(initial=0) - square, 0))]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of a and of b, both lifted: the last components, which may be huge, are subtracted before they are squared."""
    u, w = a[..., :-1], b[..., :-1]
    d = -2 * (u @ np.swapaxes(w, -1, -2))
    d += (u * u).sum(-1)[..., :, None]
    d += (w * w).sum(-1)[..., None, :]
    d += (a[..., -1][..., :, None] - b[..., -1][..., None, :]) ** 2
    return d


def _thin(x: np.ndarray, node: np.ndarray, pool: np.ndarray, most: int) -> np.ndarray:
    """For each node (row of pool: candidates, -1 for none) at most `most` neighbours by the rule above, then the nearest others."""
    out = np.full((len(node), most), -1, np.int32)
    for a in range(0, len(node), 256):
        i, c = node[a : a + 256], pool[a : a + 256]
        y = x[np.maximum(c, 0)]
        d = ((y - x[i][:, None]) ** 2).sum(2)
        d[c < 0] = np.inf
        by = np.argsort(d, axis=1, kind="stable")
        c, d, y = np.take_along_axis(c, by, 1), np.take_along_axis(d, by, 1), np.take_along_axis(y, by[:, :, None], 1)
        between = _apart(y, y)
        kept = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            hidden = (kept & (between[:, j] < d[:, j : j + 1])).any(1)
            kept[:, j] = np.isfinite(d[:, j]) & ~hidden & (kept.sum(1) < most)
        rank = np.where(kept, 0, np.where(np.isfinite(d), 1, 2)) * c.shape[1] + np.arange(c.shape[1])
        take = np.argsort(rank, axis=1, kind="stable")[:, :most]
        got = np.where(np.isfinite(np.take_along_axis(d, take, 1)), np.take_along_axis(c, take, 1), -1)
        out[a : a + 256, : got.shape[1]] = got
    return out


def _link_back(x: np.ndarray, near: np.ndarray, new: np.ndarray, most: int) -> None:
    """Every neighbour of a new node gets the node; lists that grow too long are thinned. near: places in x, a row for each place."""
    src = np.repeat(new, most)
    dst = near[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    old = np.unique(dst)
    have = near[old]
    src = np.r_[src, have[have >= 0]]
    dst = np.r_[dst, np.repeat(old, (have >= 0).sum(1))]
    n = len(near)
    pair = np.unique(dst.astype(np.int64) * n + src)
    dst, src = pair // n, pair % n
    first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    size = np.diff(np.r_[first, len(dst)])
    for lo, hi in ((0, most), (most, 2 * most), (2 * most, 8 * most), (8 * most, n + 1)):
        some = np.flatnonzero((size > lo) & (size <= hi))
        step = 4096 if hi < 8 * most else 64
        for a in range(0, len(some), step):
            g = some[a : a + step]
            wide = int(size[g].max())
            at = first[g][:, None] + np.arange(wide)[None]
            ok = np.arange(wide)[None] < size[g][:, None]
            pool = np.where(ok, src[np.minimum(at, len(src) - 1)], -1).astype(np.int32)
            node = dst[first[g]].astype(np.int64)
            if wide <= most:
                near[node] = -1
                near[node, :wide] = pool
                continue
            if wide > 4 * POOL:  # a hub: thinned among its nearest
                y = ((x[np.maximum(pool, 0)] - x[node][:, None]) ** 2).sum(2)
                y[pool < 0] = np.inf
                pool = np.take_along_axis(pool, np.argpartition(y, 4 * POOL, axis=1)[:, : 4 * POOL], 1)
            near[node] = _thin(x, node, pool, most)


def layer(x: np.ndarray, nodes: np.ndarray, most: int, above: list[np.ndarray]) -> np.ndarray:
    """Neighbour array of one layer, a row for each place in x (-1: none). nodes come in the order given, those of the layers above first;
    above: arrays of these layers, the highest first."""
    near = np.full((len(x), most), -1, np.int32)
    # lifted vectors are equally long, so the nearest one has the largest product; but products of far too long vectors say nothing of distances
    length = np.sqrt((x[:, :-1] ** 2).sum(1))
    flat = x.astype(np.float32) if length.max(initial=0) <= 30 * np.median(length) else None
    near_by = x if flat is None else flat  # of like lengths, distances of 32-bit floats will do
    upper = int((above[-1] >= 0).any(1).sum()) if above else 0
    done = 0
    while done < len(nodes):
        new = nodes[done : done + min(BATCH, max(64, done // 2))]
        pool = np.full((len(new), POOL + BESIDE), -1, np.int32)
        for a in range(0, len(new), AT_ONCE):
            some = new[a : a + AT_ONCE]
            inner = _apart(near_by[some], near_by[new])
            inner[np.arange(len(some)), a + np.arange(len(some))] = np.inf
            want = min(BESIDE if done else POOL, len(new) - 1)
            if want > 0:
                pool[a : a + AT_ONCE, :want] = new[np.argpartition(inner, want - 1, axis=1)[:, :want]]
            if not done:
                continue
            if flat is not None:
                own = flat[some]
                score = lambda r, c: np.einsum("id,id->i", flat[c], own[r])  # noqa: E731, B023
            else:
                score = lambda r, c: -((x[c] - x[some[r]]) ** 2).sum(-1)  # noqa: E731, B023
            start = np.tile(nodes[: min(8, done)], (len(some), 1))
            if done >= upper:
                for table in above:
                    start, _ = _beam(score, table, start, 8, 2)
            pool[a : a + AT_ONCE, BESIDE:], _ = _beam(score, near, start, POOL, 8)
        near[new] = _thin(near_by, new, pool, most)
        _link_back(near_by, near, new, most)
        done += len(new)
    return near


def build(v: np.ndarray, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest up: (nodes, neighbour array of these nodes)."""
    rng = np.random.default_rng(seed)
    x = lifted(scaled(v))
    level = np.floor(-np.log(1 - rng.random(len(v))) / np.log(M)).astype(int)
    order = np.lexsort((rng.random(len(v)), -level))  # nodes of high layers first
    out, above = [], []
    for h in range(level.max(initial=0), -1, -1):
        nodes = order[level[order] >= h]
        near = layer(x, nodes, 2 * M if h == 0 else M, above)
        above.append(near)
        out.append((nodes, near[nodes]))
    return out[::-1]


def _beam(score_of: Callable[[np.ndarray, np.ndarray], np.ndarray], near: np.ndarray, start: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nodes found and their scores, best first, for each query; near has a row for each place (-1: none), score_of(queries, places) says how near."""
    nq = len(start)
    seen = np.zeros((nq, len(near)), bool)
    node = np.full((nq, beam), -1, np.int64)
    score = np.full((nq, beam), -np.inf)
    r, c = np.nonzero(start[:, :beam] >= 0)
    node[r, c] = start[r, c]
    score[r, c] = score_of(r, start[r, c])
    seen[r, node[r, c]] = True
    open_ = node >= 0
    live = np.arange(nq)
    while len(live):
        rank = np.where(open_[live], score[live], -np.inf)
        pick = np.argpartition(-rank, min(at_once, beam) - 1, axis=1)[:, : min(at_once, beam)]
        ok = np.take_along_axis(open_[live], pick, 1)
        busy = ok.any(1)
        live, pick, ok = live[busy], pick[busy], ok[busy]
        if not len(live):
            break
        open_[live[:, None], pick] = False
        new = near[np.maximum(node[live[:, None], pick], 0)]
        new = np.where(ok[:, :, None], new, -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], new[r, c]] = True
        got = np.full(new.shape, -np.inf)
        got[r, c] = score_of(live[r], new[r, c])
        all_node = np.c_[node[live], new]
        all_score = np.c_[score[live], got]
        all_open = np.c_[open_[live], fresh]
        top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        node[live], score[live], open_[live] = (np.take_along_axis(z, top, 1) for z in (all_node, all_score, all_open))
    node = np.where(np.isfinite(score), node, -1)
    by = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(node, by, 1), np.take_along_axis(score, by, 1)


class Graph:
    """A shard's vectors and the layers built on them, ready to be searched."""

    def __init__(self, v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.v32 = scaled(v).astype(np.float32)
        self.far = np.argsort(-np.einsum("ij,ij->i", self.v32, self.v32, dtype=np.float64), kind="stable")[:LONGEST]
        self.full, self.top = [], layers[-1][0][:16]
        for nodes, near in layers:
            table = np.full((len(v), near.shape[1]), -1, np.int32)
            table[nodes] = near
            self.full.append(table)

    def search(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """For each query up to `beam` nodes, best first (-1: none)."""
        q32 = (q / np.maximum(np.abs(q).max(axis=1, initial=0), 1e-300)[:, None]).astype(np.float32)
        score = lambda r, c: np.einsum("id,id->i", self.v32[c], q32[r])
        start = np.tile(self.top, (len(q), 1))
        for h in range(len(self.full) - 1, -1, -1):
            if h == 0:
                start = np.c_[start, np.where((start[:, :, None] == self.far).any(1), -1, self.far)]
            start, _ = _beam(score, self.full[h], start, beam if h == 0 else 16, 4 if h == 0 else 1)
        return start


def search(v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int = BEAM) -> np.ndarray:
    return Graph(v, layers).search(q, beam)


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, beam: int = BEAM, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every` the k largest inner products found.

    score is the inner product in doubles on the original vectors; ties go to the smaller vec_id. Every row is indexed. Rows with a null
    id or vector, a zero or empty vector, or null or non-finite components take no part; a row repeated exactly counts once. An empty table gives no rows.
    Equal vectors are one node, which stands for its k + 1 smallest ids: no query can return more of them, so a
    group of copies of any size is exact and costs one node. A query meets vectors with as many components as its own; components of any finite size.
    Where all candidates are fewer than k, all are returned, as the beam is wider than the shard. Other columns are not looked at, whatever their names.
    """
    vectors = valid(embeddings, vec_id, embedding).where(F.exists("v", lambda x: x != 0))
    few = Window.partitionBy("v").orderBy("vec_id")
    nodes = vectors.withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.withColumn("dim", F.size("v")), "nodes")
    shards = max(1, math.ceil(nodes.count() / shard))
    index = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def graph(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        t = t.take(np.lexsort(([x[0] for x in t.column("ids").to_pylist()],)))
        layers = build(matrix(t.column("v"), dim))
        place = pa.array(np.arange(len(t)), pa.int32())
        lowest = np.empty_like(layers[0][1])
        lowest[layers[0][0]] = layers[0][1]
        near = pa.array(list(lowest), pa.list_(pa.int32()))
        upper: list[list | None] = [None] * len(t)
        for nodes_, table in layers[1:]:
            for i, row in zip(nodes_, table):
                upper[i] = [*(upper[i] or []), *row.tolist()]
        return pa.table({"dim": t.column("dim"), "shard": t.column("shard"), "place": place, "ids": t.column("ids").cast(pa.list_(pa.int64())), "v": t.column("v").cast(pa.list_(pa.float64())), "near": near, "upper": pa.array(upper, pa.list_(pa.int32()))})

    kind = "dim int, shard int, place int, ids array<long>, v array<double>, near array<int>, upper array<int>"
    built = written(index.select("dim", "shard", "ids", "v").groupBy("dim", "shard").applyInArrow(graph, kind), "graphs")

    def load(rows: pa.Table, dim: int):
        v, ids = matrix(rows.column("v"), dim), rows.column("ids").to_pylist()
        near = np.array(rows.column("near").to_pylist(), np.int32).reshape(len(v), -1)
        above = [np.array(x or [], np.int32).reshape(-1, M) for x in rows.column("upper").to_pylist()]
        height = np.array([len(x) for x in above])
        layers = [(np.arange(len(v)), near)]
        for h in range(1, height.max(initial=0) + 1):
            at = np.flatnonzero(height >= h)
            layers.append((at, np.stack([above[i][h - 1] for i in at])))
        many = np.array([len(x) for x in ids])
        return v, Graph(v, layers), many, np.concatenate([np.array(x, np.int64) for x in ids]), np.cumsum(many) - many

    def ask(loaded, rows: pa.Table) -> pa.RecordBatch:
        v, g, many, flat, begin = loaded
        q_ids, q = rows.column("vec_id").to_numpy(), matrix(rows.column("v"), v.shape[1])
        got = g.search(q, max(beam, k + 1))
        i, j = np.nonzero(got >= 0)
        node = got[i, j]
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("id,id->i", q[i], v[node])
        top = best(i, node, score, 2 * k + 2)
        i, node, score = i[top], node[top], score[top]
        rep = many[node]
        i, score = np.repeat(i, rep), np.repeat(score, rep)
        who = flat[np.repeat(begin[node], rep) + np.arange(int(rep.sum())) - np.repeat(np.cumsum(rep) - rep, rep)]
        other = who != q_ids[i]
        i, score, who = i[other], score[other], who[other]
        top = best(i, who, score, k)
        return pa.RecordBatch.from_arrays([pa.array(q_ids[i[top]]), pa.array(who[top]), pa.array(score[top])], names=["query_id", "vec_id", "score"])

    queries = to_shards(queries_of(vectors, every), built.select("dim", "shard").distinct())
    found = beside(built, queries).mapInArrow(lean(by_shard(load, ask)), "query_id long, vec_id long, score double")
    out = written(ranked(found, k), "ranks")
    dropped(nodes, built)
    return out
