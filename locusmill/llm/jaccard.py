"""N-gram Jaccard join: exact links between documents whose shingle sets have a Jaccard distance of 0.2 or less.

The metric space is that of shingle sets. Two kinds of pivots cut it into regions:

1. Single shingles. All shingles have one global order (rare ones first, by a counting sketch over all documents). A set
   within the radius of another must share with it one of its first n - ceil(0.8 n) + 1 shingles, so each of those is a
   pivot into whose region the document is copied; documents that share no such pivot can't be linked. Documents without a common shingle are at
   distance 1 from each other, so pivots that are documents would have all others at one distance and part nothing at this level.
2. Documents. Inside a region, sets are compared by parity bitmaps: the bits in which two differ are never more than
   the shingles in which the sets differ, and that count is a metric. The empty set is the first pivot: its shells are sizes. A shell is cut into
   Voronoi cells around documents that lie far apart. A document is also copied to each cell that it is near enough to by the triangle inequality: at most twice the
   radius further from its pivot than from its own one, and at most the radius further than any document of the cell. Cells are joined in
   the same way until they are small or pivots part them no more. No link can be lost: one of a pair's two documents is at home in a cell to which the other is copied.

Whatever the bitmaps leave is verified on the shingle sets themselves. Documents with equal sets are one node. Near copies of
one document are linked to a pivot document first (same minhash, verified); pairs that those links join already
are not looked at again, so a group of n copies costs about n pairs, not n * n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm._tables import bitmap, dropped, small, texts_of, with_bit, written
from locusmill.llm._words import U, lean, mix, pieces, shingle_sets
from locusmill.llm.components import connected_components

SKETCH_BITS, SKETCH_CHUNK = 20, 1 << 14
MINHASHES = 6
CELL = 8  # documents of a region that aren't cut any further
PIVOTS = 8
REGION = 8192  # documents of a region in one task; larger regions go out as pairs of blocks


def _need(n, percent: int):
    """Least overlap with itself that a set of n keeps in common with any set within the radius."""
    return (percent * n + 99) // 100


def sketch_levels(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """For each of 2^20 cells the logarithm of how many shingles of all documents fall into it: 1 MB, whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = list(shingle_sets(part.column("text"), k))
                if sets:
                    total += np.bincount(_cell(np.concatenate(sets)), minlength=len(total))
        for a in range(0, len(total), SKETCH_CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([a // SKETCH_CHUNK], pa.int32()), pa.array([total[a : a + SKETCH_CHUNK].astype("<u4").tobytes()], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                v = np.frombuffer(b, "<u4").astype(np.int64)
                sums[c] = sums[c] + v if c in sums else v
        for c, v in sums.items():
            level = np.floor(np.log2(np.maximum(v, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "counts"])

    parts = docs.select(docs[text].cast("string").alias("text")).mapInArrow(lean(count), "chunk int, counts binary").repartition(F.col("chunk"))
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in parts.mapInArrow(lean(add), "chunk int, counts binary").collect():
        out[r.chunk * SKETCH_CHUNK : (r.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(r.counts, np.uint8)
    return out


def _cell(s: np.ndarray) -> np.ndarray:
    return ((s >> U(20)) & U((1 << SKETCH_BITS) - 1)).astype(np.int64)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Parity of how many of the set's hashes fall on each bit, as 64-bit words; two to four bits for each shingle, a power of two."""
    m = max(64, 1 << int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s & U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap as it would be with fewer bits: halves are laid over each other by exclusive or."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _features(docs: DataFrame, text: str, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    value = docs[text].cast("string")
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(value).alias("dg"), value.alias("text"))
    seeds = [U(0x9E3779B97F4A7C15 * (2 * j + 1) % (1 << 64)) for j in range(MINHASHES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                n, h1, h2, mins, first, bits = [], [], [], [], [], []
                for s in shingle_sets(part.column("text"), k):
                    n.append(len(s))
                    if not len(s):
                        h1.append(0), h2.append(0), mins.append(None), first.append(None), bits.append(None)
                        continue
                    t = mix(s.copy())
                    h1.append(int(t.sum(dtype=U).view(np.int64)))
                    h2.append(int(np.bitwise_xor.reduce(mix(t + U(1))).view(np.int64)))
                    mins.append([int(mix(s ^ x).min().view(np.int64)) for x in seeds])
                    order = np.argsort(level[_cell(s)], kind="stable")[: len(s) - _need(len(s), percent) + 1]
                    first.append(s[order].tobytes())
                    bits.append(parity_bits(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("dg"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(mins, pa.list_(pa.int64())), pa.array(first, pa.binary()), pa.array(bits, pa.binary())],
                    names=["doc_id", "dg", "n", "h1", "h2", "mins", "first", "bits"],
                )

    rows = src.mapInArrow(lean(run), "doc_id long, dg long, n long, h1 long, h2 long, mins array<long>, first binary, bits binary")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, k: int, percent: int, group: int = 1000) -> DataFrame:
    """Those pairs (a, b: rows of sets) whose shingle sets have the overlap asked for.

    Each text in a pair is read once, and its set goes to the groups of `group` pairs in which it is compared: all pairs of one b meet there
    with b's set, which is repeated for each further group. What is moved is about one set for each pair. Texts are found by doc_id and a
    digest, so rows that share an id, or have none, don't meet; of equal rows a task passes on the first."""
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    groups = pairs.groupBy(F.col("b").alias("g")).agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("salts"))
    left = pairs.join(groups, F.col("b") == F.col("g")).select(F.col("a").alias("row"), F.struct("g", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side")).alias("t"))
    right = groups.select(F.col("g").alias("row"), F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda i: F.struct(F.col("g"), i.alias("salt"), F.lit(0).alias("side")))).alias("t"))
    targets = left.union(right).groupBy("row").agg(F.collect_list("t").alias("t"))
    wanted = written(targets.join(sets.select("row", "doc_id", "dg", "h1", "h2"), "row").select("row", "doc_id", "dg", "h1", "h2", F.col("t.g").alias("g"), F.col("t.salt").alias("salt"), F.col("t.side").alias("side")), "wanted")
    found = texts_of(docs, text, wanted).select("row", "h1", "h2", "g", "salt", "side", "text")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                out: list[list] = [[], [], [], [], []]
                cols = [part.column(c).to_pylist() for c in ("row", "h1", "h2", "g", "salt", "side")]
                for r, a, b, g, salt, side, s in zip(*cols, shingle_sets(part.column("text"), k)):
                    if r in seen:
                        continue
                    seen.add(r)
                    t = mix(s.copy())
                    if len(s) and int(t.sum(dtype=U).view(np.int64)) == a and int(np.bitwise_xor.reduce(mix(t + U(1))).view(np.int64)) == b:
                        blob = s.tobytes()
                        for o, x in zip(out, (g, salt, side, [r] * len(g), [blob] * len(g))):
                            o += x
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["g", "salt", "side", "row", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one = None, np.empty(0, U)
        for batch in batches:
            a, b = [], []
            for g, salt, side, r, s in zip(*(batch.column(c).to_pylist() for c in ("g", "salt", "side", "row")), batch.column("s")):
                y = np.frombuffer(s.as_buffer(), U)
                if side == 0:
                    key, one = (g, salt), y.copy()
                elif key == (g, salt) and 100 * min(len(one), len(y)) >= percent * max(len(one), len(y)):
                    at = np.searchsorted(one, y)
                    common = int((one[np.minimum(at, len(one) - 1)] == y).sum())
                    if 100 * common >= percent * (len(one) + len(y) - common):
                        a.append(r)
                        b.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = found.mapInArrow(lean(deal), "g long, salt int, side int, row long, s binary").repartition(F.col("g"), F.col("salt")).sortWithinPartitions("g", "salt", "side")
    out = written(dealt.mapInArrow(lean(compare), "a long, b long").distinct(), "verified")
    dropped(wanted)
    return out


def _region_rows(nodes: DataFrame) -> DataFrame:
    """s, label, n, pos, row, more: the regions into which each node is copied, pos being the place of s in the node's order. In each batch, nodes of one label and size class in one region
    are a single row, so that a region in which a third of all nodes meet gets a row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, label, n = (batch.column(c).to_numpy() for c in ("row", "label", "n"))
            sets = [np.frombuffer(x.as_buffer(), U) for x in batch.column("first")]
            if not sets:
                continue
            count = np.array([len(x) for x in sets])
            s = np.concatenate(sets).view(np.int64)
            of = np.repeat(np.arange(len(row)), count)
            pos = (np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int64)
            single = np.ones(len(s), bool)
            out = [[], [], [], [], [], []]
            many = np.bincount(np.unique(label, return_inverse=True)[1])[np.unique(label, return_inverse=True)[1]] > 1
            grouped = many[of]
            if grouped.any():  # only labels that occur more than once in the batch
                gs, go, gp = s[grouped], of[grouped], pos[grouped]
                order = np.lexsort((row[go], label[go], gs))
                gs, go, gp = gs[order], go[order], gp[order]
                begin = np.flatnonzero(np.r_[True, (gs[1:] != gs[:-1]) | (label[go][1:] != label[go][:-1])])
                for a, b in zip(begin, np.r_[begin[1:], len(gs)]):
                    rest = go[a + 1 : b]
                    out[0].append(gs[a]), out[1].append(label[go[a]]), out[2].append(n[go[a]]), out[3].append(row[go[a]])
                    out[4].append(np.stack([row[rest], n[rest], gp[a + 1 : b]], 1).tobytes() if len(rest) else None)
                    out[5].append(gp[a])
                single = ~grouped
            o = of[single]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[s[single], np.array(out[0], np.int64)]), pa.array(np.r_[label[o], np.array(out[1], np.int64)]), pa.array(np.r_[n[o], np.array(out[2], np.int64)].astype(np.int32)), pa.array(np.r_[row[o], np.array(out[3], np.int64)]), pa.array([None] * len(o) + out[4], pa.binary()), pa.array(np.r_[pos[single], np.array(out[5], np.int64)].astype(np.int32))],
                names=["s", "label", "n", "row", "more", "pos"],
            )

    return nodes.mapInArrow(lean(run), "s long, label long, n int, row long, more binary, pos int")


def _common(nx, ny, percent: int):
    """Least number of common shingles with which sets of nx and ny shingles link."""
    return -(-percent * (nx + ny) // (100 + percent))


def _members(regions: DataFrame, percent: int, hold: int = 200_000, pairs_of: int = 64) -> DataFrame:
    """s, row, label, pos, n: nodes of regions in which they can meet another one of a different label for the first time.

    If s is the first common shingle of two sets, they have no more in common than what follows it in either order; so sizes and places of s
    tell most pairs apart. In regions of up to `pairs_of` nodes each pair is looked at, in larger ones sizes alone. Rows come sorted by
    region; no more than `hold` are kept, a longer region is passed on in parts whatever is in it."""

    def keep_small(s, label, n, pos, begin, k):
        keep = np.zeros(len(s), bool)
        i, j = np.triu_indices(k, 1)
        step = max(1, (1 << 20) // len(i))
        for a in range(0, len(begin), step):
            at = begin[a : a + step][:, None]
            x, y = at + i[None], at + j[None]
            need = _common(n[x], n[y], percent)
            ok = (label[x] != label[y]) & (need <= n[x] - pos[x]) & (need <= n[y] - pos[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            keep[x[ok]] = True
            keep[y[ok]] = True
        return keep

    def emit(s, row, label, n, pos, whole: bool):
        order = np.lexsort((n, s))
        s, row, label, n, pos = s[order], row[order], label[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        keep = np.ones(len(s), bool)
        if whole:
            begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[begin, len(s)])
            # a run: one region, each size near enough to the one before
            new = np.r_[True, (s[1:] != s[:-1]) | (100 * n[:-1] < percent * n[1:])]
            run, at = np.cumsum(new) - 1, np.flatnonzero(new)
            keep = np.minimum.reduceat(label, at)[run] != np.maximum.reduceat(label, at)[run]
            few = np.repeat(size <= pairs_of, size)
            keep &= ~few
            for k in np.unique(size[(size > 1) & (size <= pairs_of)]):
                keep |= keep_small(s, label, n, pos, begin[size == k], int(k))
        return pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(row[keep]), pa.array(label[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32))], names=["s", "row", "label", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, split = None, None
        for batch in batches:
            s, label, n, row, pos = (batch.column(c).to_numpy() for c in ("s", "label", "n", "row", "pos"))
            more = batch.column("more")
            if more.null_count < len(more):
                extra = [(i, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3)) for i, x in enumerate(more) if x.is_valid]
                of = np.repeat([i for i, _ in extra], [len(x) for _, x in extra])
                rest = np.concatenate([x for _, x in extra])
                s, label, n, row, pos = np.r_[s, s[of]], np.r_[label, label[of]], np.r_[n, rest[:, 1].astype(n.dtype)], np.r_[row, rest[:, 0]], np.r_[pos, rest[:, 2].astype(pos.dtype)]
            if not len(s):
                continue
            now = (s, row, label, n, pos)
            held = now if held is None else tuple(np.r_[a, b] for a, b in zip(held, now))
            last = batch.column("s")[len(batch) - 1].as_py()
            open_ = held[0] == last
            for part in (~open_ & (held[0] == split), ~open_ & (held[0] != split)) if split is not None else (~open_,):
                if part.any():
                    yield emit(*(x[part] for x in held), bool(split is None or held[0][part][0] != split))
            held = tuple(x[open_] for x in held)
            if len(held[0]) > hold:
                yield emit(*held, False)
                held, split = None, last
        if held is not None and len(held[0]):
            yield emit(*held, bool(split is None or held[0][0] != split))

    return regions.repartition(F.col("s")).sortWithinPartitions("s").mapInArrow(lean(run), "s long, row long, label long, pos int, n int")


def close_pairs(bits: list[np.ndarray], n: np.ndarray, label: np.ndarray, percent: int, pos: np.ndarray | None = None, cell: int | None = None, told: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with different labels that bitmaps and sizes don't rule out, and by how far: recursive Voronoi cells with triangle windows.

    Sets within the radius differ in at most (100 - percent) / (100 + percent) * (n_i + n_j) shingles, and bitmaps in no more bits.
    pos: places of the region's shingle in their orders; pairs for which it can't be the first common one are left to another region.
    Bitmaps are compared in tiles of half a million words, however many documents there are. told: counts of cells cut, of documents copied to
    cells, of pairs compared, and of pairs that would be compared without cells."""
    share = (100 - percent) / (100 + percent)
    cell = CELL if cell is None else cell
    found: list[np.ndarray] = []
    spare: list[np.ndarray] = []
    told = {} if told is None else told
    radius = share * (1 + 100 / percent) * n  # of a document: its partner is at most 100 / percent times as large

    def count(name: str, by: int) -> None:
        told[name] = told.get(name, 0) + int(by)

    def stacked(at: np.ndarray, words: int) -> np.ndarray:
        return np.stack([folded(bits[i], words) for i in at])

    def direct(at: np.ndarray, home: np.ndarray) -> None:
        """at: in order of size; pairs of which one document at least is at home."""
        size, own = n[at], label[at]
        if (own == own[0]).all():
            return
        a = 0
        while a < len(at) - 1:
            b = min(a + 64, int(np.searchsorted(size, 2 * size[a], "right")))
            end = int(np.searchsorted(size, size[b - 1] * 100 // percent, "right"))
            words = len(bits[at[a]])
            left, step = stacked(at[a:b], words), max(32, (1 << 19) // (64 * words))
            for c in range(a + 1, end, step):
                d = min(end, c + step)
                differ = np.bitwise_count(left[:, None, :] ^ stacked(at[c:d], words)[None]).sum(axis=2, dtype=np.int64)
                x, y = size[a:b][:, None], size[c:d][None]
                ok = (differ <= share * (x + y) + 1e-9) & (own[a:b][:, None] != own[c:d][None]) & (100 * x >= percent * y) & (np.arange(a, b)[:, None] < np.arange(c, d)[None]) & (home[a:b][:, None] | home[c:d][None])
                count("compared", (b - a) * (d - c))
                if pos is not None:
                    ok &= _common(x, y, percent) <= np.minimum(x - pos[at[a:b]][:, None], y - pos[at[c:d]][None])
                i, j = np.nonzero(ok)
                if len(i):
                    found.append(np.stack([at[a + i], at[c + j]], 1))
                    spare.append((share * (x + y) - differ)[i, j])
            a = b

    def cut(at: np.ndarray, home: np.ndarray, depth: int) -> None:
        if len(at) <= cell or depth > 16 or (label[at] == label[at[0]]).all():
            return direct(at, home)
        words = min(len(bits[i]) for i in at)
        top = stacked(at, words)
        far = np.empty((len(at), 0), np.int64)
        pivot = len(at) // 2
        while far.shape[1] < PIVOTS:  # each next pivot is the document that is furthest from all pivots so far
            far = np.c_[far, np.bitwise_count(top ^ top[pivot]).sum(axis=1, dtype=np.int64)]
            nearest = far.min(axis=1)
            pivot = int(nearest.argmax())
            if nearest[pivot] <= radius[at[pivot]] / 2:
                break
        own, pivots = far.argmin(axis=1), range(far.shape[1])
        reach = np.array([far[own == p, p].max(initial=-1) for p in pivots])
        r = radius[at][:, None] + 1e-9
        inside = (far <= reach[None] + r) & (far - nearest[:, None] <= 2 * r)
        homes = np.array([(home & (own == p)).sum() for p in pivots])
        if (homes * inside.sum(axis=0)).sum() > 0.75 * home.sum() * len(at):  # pivots don't part these
            return direct(at, home)
        count("cells", (homes > 0).sum())
        count("copied", inside.sum() - len(at))
        for p in pivots:
            if homes[p]:
                there = inside[:, p]
                cut(at[there], (home & (own == p))[there], depth + 1)

    order = np.argsort(n, kind="stable")  # sizes further apart than the radius never meet
    gap = np.flatnonzero(np.r_[True, 100 * n[order][:-1] < percent * n[order][1:]])
    for a, b in zip(gap, np.r_[gap[1:], len(order)]):
        if b - a < 2:
            continue
        count("pairs", (b - a) * (b - a - 1) // 2)
        at, size = order[a:b], n[order[a:b]]
        low = 0
        while low < len(at):  # shells around the empty set: the smaller one of a pair is at home, its partner may be in the next shell
            high = int(np.searchsorted(size, 2 * size[low], "left"))
            end = int(np.searchsorted(size, size[high - 1] * 100 // percent, "right"))
            if end - low > 1:
                cut(at[low:end], np.arange(low, end) < high, 0)
            low = high
    if not found:
        return np.empty((0, 2), np.int64), np.empty(0)
    pairs, first = np.unique(np.sort(np.concatenate(found), axis=1), axis=0, return_index=True)
    return pairs, np.concatenate(spare)[first]


def forest(pairs: np.ndarray, spare: np.ndarray, label: np.ndarray, times: int = 2) -> np.ndarray:
    """Places of pairs that join labels into trees, those with most to spare first; `times` trees without common pairs."""
    left = np.argsort(-spare, kind="stable")
    nodes, number = np.unique(label, return_inverse=True)
    out: list[int] = []
    for _ in range(times):
        up = list(range(len(nodes)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        parts, rest = len(np.unique(number[pairs[left]])) if len(left) else 0, []
        for k, p in enumerate(left):
            a, b = root(number[pairs[p, 0]]), root(number[pairs[p, 1]])
            if a == b:
                rest.append(p)
                continue
            up[a] = b
            out.append(int(p))
            parts -= 1
            if parts == 1:
                rest.extend(left[k + 1 :])
                break
        left = np.array(rest, np.int64)
    return np.array(out, np.int64)


def _candidates(members: DataFrame, sets: DataFrame, percent: int, trees: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different labels that a region's bitmaps leave; trees: of each region only pairs that join its labels to trees, and
    for regions with more than those a row with their s and no pair."""
    # sizes of two that link are in one or two neighbouring buckets; a bucket of more than REGION documents goes out in blocks
    bucket = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    sized = members.withColumn("k", bucket)
    counts = sized.groupBy("s", "k").agg(F.count(F.lit(1)).alias("m"))
    big = counts.groupBy(F.col("s").alias("bs")).agg(F.sum("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("k", F.ceil(F.col("m") / REGION).cast("int")))).alias("blocks")).where(F.col("m") > REGION).select("bs", "blocks")
    code = lambda k, j: (k.cast("long") * (1 << 32) + j).alias("c")
    there = lambda d: F.when(F.coalesce(F.try_element_at("blocks", F.col("k") + d), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.try_element_at("blocks", F.col("k") + d) - 1), lambda j: code(F.col("k") + d, j))).otherwise(F.array().cast("array<long>"))
    put = sized.join(big, F.col("s") == F.col("bs"), "left").withColumn("own", code(F.col("k"), F.pmod(F.xxhash64("row"), F.try_element_at("blocks", F.col("k"))).cast("int")))
    put = put.withColumn("other", F.explode(F.when(F.col("bs").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.concat(there(-1), there(0), there(1)))))
    put = put.withColumn("own", F.coalesce("own", F.lit(0).cast("long"))).select("s", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "row", "label", "pos")
    full = put.join(sets.select("row", "n", "bits"), "row").select("s", "x", "y", "row", "label", "pos", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, more = [], []

        def close(s: int, rows: list[tuple]) -> None:
            row, label, n, pos = (np.array([r[j] for r in rows], np.int64) for j in range(4))
            got, spare = close_pairs([r[4] for r in rows], n, label, percent, pos)
            if trees and len(got) > 1:
                at = forest(got, spare, label)
                if len(at) < len(got):
                    more.append(s)
                got = got[at]
            if len(got):
                out.append(np.stack([np.minimum(row[got[:, 0]], row[got[:, 1]]), np.maximum(row[got[:, 0]], row[got[:, 1]])], 1))

        def flush() -> pa.RecordBatch:
            # a is the larger row, so that pairs are verified beside the smaller one
            p = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
            none = [None] * len(more)
            cols = [pa.array([*p[:, 1].tolist(), *none], pa.int64()), pa.array([*p[:, 0].tolist(), *none], pa.int64()), pa.array([None] * len(p) + more, pa.int64())]
            out.clear(), more.clear()
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "s"])

        key, held = None, []
        for batch in batches:
            for s, x, y, row, label, n, pos, b in zip(*(batch.column(c).to_pylist() for c in ("s", "x", "y", "row", "label", "n", "pos")), batch.column("bits")):
                if (s, x, y) != key:
                    if len(held) > 1:
                        close(key[0], held)
                    key, held = (s, x, y), []
                held.append((row, label, n, pos, np.frombuffer(b.as_py(), U)))
            if sum(map(len, out)) + len(more) > 10_000:
                yield flush()
        if len(held) > 1:
            close(key[0], held)
        yield flush()

    return written(full.repartition(F.col("s"), F.col("x"), F.col("y")).sortWithinPartitions("s", "x", "y").mapInArrow(lean(run), "a long, b long, s long").distinct(), "pairs")


def near_duplicates(docs: DataFrame, text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links): one row for each input row.

    Two documents link when 100 * common >= percent * united shingles. With fewer than k words the whole sequence is one shingle;
    a text that is null, empty or blank has none and is linked with nothing, its component is its own doc_id. Rows with equal
    shingle sets (repeated rows too) link. A null doc_id stays null and counts for a component only if there's no other.
    Shingles are 64-bit hashes; very long texts are read whole. Other columns of docs are not looked at, whatever their names. An empty table gives no rows.
    """
    sets = _features(docs, text, k, percent, sketch_levels(docs, text, k))
    some = sets.where("n > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h1", "h2", "node")
    classes = written(classes, "classes")  # as a table of its own, so that the join can be broadcast or split
    copies = written(some.select("row", "h1", "h2").join(small(classes), ["h1", "h2"]).where("row <> node").select("row", "node"), "copies")
    doubles = bitmap(copies, F.col("row"), "doubles")
    first_of = lambda df: with_bit(df, F.col("row"), doubles, "__double").where("NOT __double").drop("__double")
    exploded = first_of(some.select("row", "mins")).select("row", F.posexplode("mins").alias("j", "h"))
    pivots = exploded.groupBy("j", "h").agg(F.min("row").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1").select("j", "h", "pivot")
    pivots = written(pivots, "pivots")
    stars = written(exploded.join(small(pivots), ["j", "h"]).where("row <> pivot").select(F.col("row").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    star_links = _verified(stars, sets, docs, text, k, percent)
    trees = connected_components(star_links)
    labels = written(trees, "labels")
    nodes = first_of(some.select("row", "n", "first"))
    nodes = nodes.join(small(labels), nodes["row"] == labels["node"], "left").select("row", F.coalesce("label", "row").alias("label"), "n", "first")
    members = written(_members(_region_rows(nodes), percent), "members")
    some_pairs = _candidates(members, sets, percent, trees=True)
    links = _verified(some_pairs.select("a", "b"), sets, docs, text, k, percent)
    dropped(classes, pivots, stars, trees, labels)
    every = copies.select(F.col("row").alias("a"), F.col("node").alias("b")).union(star_links).union(links)
    gone = [copies, doubles, star_links, links, members, some_pairs, sets]
    # regions where trees may have left a link out: all other pairs of what is still apart
    rest = written(some_pairs.where("s IS NOT NULL").select("s").distinct(), "rest")
    if rest.limit(1).count():
        trees = connected_components(star_links.union(links))
        now = written(trees, "labels")
        left = members.drop("label").join(small(rest), "s", "left_semi").join(small(now), F.col("row") == F.col("node"), "left").select("s", "row", F.coalesce("label", "row").alias("label"), "pos", "n")
        apart = written(left.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("s"), "apart")
        all_pairs = _candidates(left.join(small(apart), "s", "left_semi"), sets, percent, trees=False)
        untried = all_pairs.select("a", "b").join(some_pairs.select("a", "b"), ["a", "b"], "left_anti")
        more = _verified(untried, sets, docs, text, k, percent)
        every = every.union(more)
        dropped(all_pairs, trees, now, apart)
        gone.append(more)
    parts = connected_components(every)
    known = sets.select("row", "doc_id", "n").join(parts, F.col("row") == F.col("node"), "left").select("row", "doc_id", "n", "label")
    known = written(known, "components")
    least = known.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    dropped(rest, parts, *gone)
    return known.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(0, len(w) - 4), lambda a: array_to_string(w[a + 1:a + 5], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM d),
h AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS h, s FROM s),
c AS (SELECT h, min(doc_id) AS node, any_value(s) AS s, any_value(n) AS n FROM h WHERE n > 0 GROUP BY h),
e AS (SELECT node, n, unnest(s) AS t FROM c),
p AS (SELECT a.node AS x, b.node AS y, a.n AS nx, b.n AS ny, count(*) AS both_ FROM e a JOIN e b ON a.t = b.t AND a.node < b.node GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * both_ >= 80 * (nx + ny - both_)),
l2 AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, label) AS (SELECT node, node FROM c UNION SELECT l2.y, r.label FROM r JOIN l2 ON l2.x = r.node),
k AS (SELECT node, min(label) AS label FROM r GROUP BY node)
SELECT h.doc_id, h.n::BIGINT AS n_shingles, coalesce(k.label, h.doc_id) AS component_id FROM h LEFT JOIN c ON h.h = c.h AND h.n > 0 LEFT JOIN k ON k.node = c.node
"""
