"""Suffix-array dedup with a sparse suffix array: passages of at least `least` words that occur in more than one document.

Only suffixes at minimiser positions are kept: of every `least` consecutive words, the position whose k words have the smallest
hash, which depends on nothing but those words. So equal passages keep the same suffixes. With each suffix goes its stretch: all
windows of `least` words for which it was selected.

1. Suffixes are counted by their first k words and by stretch. One whose k words no other document has can't be in a repeat.
   Documents with one stretch in common share all of it, so it needs one of them, the first, to stand for it.
2. What stands for the different stretches of the same k words is sorted as a suffix array: by range of the words from the suffix on, to
   the stretch's end. Neighbours are compared word by word: no other suffix agrees further to the right than the nearer of its two
   neighbours. The same is done with the words before the suffix, read to the left. A window of the stretch can only be
   in another document if it ends within the match to the right and starts within the match to the left.
3. These windows are looked up among each other, which says which document has each of them first.

No sorted group has two equal rows, so no key is hot: sorting is by range, and a partition's first and last row, which lack a neighbour,
count as matching as far as their stretch goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm._tables import CELLS, bitmap, dropped, small, texts_of, with_bit, written
from locusmill.llm._words import U, lean, mix, pieces, runs_of, words

_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.ones(1, U), np.full(max(n, 1), U(base), U)])


def _spans(hashes: np.ndarray):
    """A function that gives the hash of the words from a to b (arrays), whatever their length."""
    up, down = _powers(_ODD, len(hashes)), _powers(pow(_ODD, -1, 1 << 64), len(hashes))
    total = np.r_[np.zeros(1, U), np.cumsum(hashes * up[: len(hashes)])]
    return lambda a, b: mix((total[b] - total[a]) * down[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93))


def selected(hashes: np.ndarray, rows: np.ndarray, least: int, k: int):
    """Suffixes kept: their position, the first and last window start for which each was selected, its row, and its k words' hash."""
    grams = runs_of(hashes, k)
    wide = least - k + 1
    n = len(hashes) - least + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, U),)
    best = np.arange(len(grams))
    have = 1
    while have < wide:  # argmin over ever wider stretches; ties go to the left
        step = min(have, wide - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[a] <= grams[b], a, b)
        have += step
    best = best[:n]
    ok = np.zeros(n, bool)
    owner = np.zeros(n, np.int64)
    for r, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
        if b - a >= least:
            ok[a : b - least + 1] = True
            owner[a : b - least + 1] = r
    at = np.flatnonzero(ok)
    if not len(at):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, U),)
    new = np.flatnonzero(np.r_[True, (best[at][1:] != best[at][:-1]) | (owner[at][1:] != owner[at][:-1])])
    lo, hi = at[new], at[np.r_[new[1:], len(at)] - 1]
    pos = best[lo]
    return pos, lo, hi, owner[lo], grams[pos]


def _suffixes(docs: DataFrame, text: str, least: int, k: int) -> DataFrame:
    """A written table: doc_id, th (digest of the words), dg (digest of the text), and the kept suffixes of each row as arrays."""
    value = docs[text].cast("string")
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(value).alias("dg"), value.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes, rows, *_ = words(part.column("text"), lower=False)
                span = _spans(hashes)
                pos, lo, hi, row, key = selected(hashes, rows, least, k)
                whole = mix(span(lo, hi + least) + (hi - lo).astype(U) * U(3) + (pos - lo).astype(U) * U(0x100000001B3))
                base = rows[:-1][row] if len(row) else row
                off = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (key.view(np.int64), whole.view(np.int64), *((x - base).astype(np.int32) for x in (pos, lo, hi)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(span(rows[:-1], rows[1:]).view(np.int64)), part.column("dg"), *lists], names=["doc_id", "th", "dg", "key", "whole", "pos", "lo", "hi"])

    return written(src.mapInArrow(lean(run), "doc_id long, th long, dg long, key array<long>, whole array<long>, pos array<int>, lo array<int>, hi array<int>"), "suffixes")


def _unique(found: DataFrame) -> bool:
    """Whether each row has an id of its own: then the order of doc_id alone is that of (doc_id, th)."""
    rows, ids, distinct = found.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id")).first()
    return rows == ids == distinct


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of word hashes (8 bytes each) as a matrix with a row for each, and how many words each has."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(">u8") if data is not None else np.empty(0, ">u8")
    begin, size = (off[:-1] - off[0]) // 8, np.diff(off) // 8
    wide = np.arange(int(size.max(initial=0)))[None]
    at = np.minimum(begin[:, None] + wide, max(len(flat) - 1, 0))
    return (np.where(wide < size[:, None], flat[at], 0) if len(flat) else np.zeros(at.shape, U)).astype(U), size


def common_words(column: pa.Array) -> np.ndarray:
    """How many first words each row has in common with the row before it; 0 for the first."""
    m, size = _matrix(column)
    out = np.zeros(len(size), np.int64)
    if len(size) > 1 and m.shape[1]:
        differ = m[1:] != m[:-1]
        out[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), m.shape[1]), np.minimum(size[1:], size[:-1]))
    return out


def _beside(column: str, group: str | None, use: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None]):
    """For mapInArrow over rows in order of (group,) column: use(rows, reach), reach being how many words of `column` a row has in common with the nearer of
    its neighbours. A partition's first and last row may have a neighbour elsewhere: all their words count. One row is held over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row so far, and what it has in common with the one before it

        def give(rows: pa.RecordBatch, before: int | None, last: bool):
            reach = common_words(rows.column(column))
            if group:
                g = rows.column(group).to_numpy()
                reach[1:][g[1:] != g[:-1]] = 0
            size = np.array([len(x.as_buffer()) // 8 for x in (rows.column(column)[0], rows.column(column)[len(rows) - 1])])
            after = np.r_[reach[1:], size[1]]
            mine = np.r_[size[0] if before is None else before, reach[1:]]
            n = len(rows) if last else len(rows) - 1
            out = use(rows.slice(0, n), np.maximum(mine, after)[:n]) if n else None
            return out, int(mine[-1])

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            out, before = give(rows, before, False)
            if out is not None and len(out):
                yield out
            held = rows.slice(len(rows) - 1, 1)
        if held is not None:
            out, _ = give(pa.Table.from_batches([held]).combine_chunks().to_batches()[0], before, True)
            if out is not None and len(out):
                yield out

    return run


CONTEXT = "key long, right binary, left binary, room int, doc_id long, th long, many boolean, places array<int>"


def _contexts(docs: DataFrame, text: str, reps: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """A written table of what stands for a stretch: its words from the suffix on (right), those before it from there to the left (left), how many
    windows it has beyond the first (room), and where the document has it (places)."""
    per = reps.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "whole", "pos", "lo", "hi", "many")).alias("z")).alias("p")
    ids = found.groupBy("doc_id", "th").agg(F.min("dg").alias("dg")).alias("i")
    same = F.col("p.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("p.th") == F.col("i.th"))
    wanted = written(per.join(ids, same).select("p.doc_id", "p.th", "i.dg", *[F.col(f"p.z.{c}").alias(c) for c in ("key", "whole", "pos", "lo", "hi", "many")]), "wanted")
    texts = texts_of(docs, text, wanted).select("doc_id", "th", "key", "whole", "pos", "lo", "hi", "many", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # a document of several equal rows goes once from here; the rest are equal rows, which do no harm
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                hashes, rows, *_ = words(part.column("text"), lower=False)
                th = _spans(hashes)(rows[:-1], rows[1:]).view(np.int64)
                out: list[list] = [[] for _ in range(8)]
                for i, (doc, meant) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("th").to_pylist())):
                    if meant != th[i] or (doc, meant) in seen:
                        continue
                    seen.add((doc, meant))
                    own = hashes[rows[i] : rows[i + 1]].astype(">u8")
                    places: dict[tuple, list] = {}
                    for key, whole, pos, lo, hi, many in zip(*(part.column(c)[i].as_py() for c in ("key", "whole", "pos", "lo", "hi", "many"))):
                        places.setdefault((key, whole), [pos, lo, hi, many, []])[4].append(lo)
                    for (key, _), (pos, lo, hi, many, at) in places.items():
                        for o, x in zip(out, (key, own[pos : hi + least].tobytes(), own[lo:pos][::-1].tobytes(), hi - lo, doc, meant, many, at)):
                            o.append(x)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=["key", "right", "left", "room", "doc_id", "th", "many", "places"])

    made = written(texts.mapInArrow(lean(run), CONTEXT), "contexts")
    dropped(wanted)
    return made


def _windows(contexts: DataFrame, least: int) -> DataFrame:
    """A written table of the windows that may be in another document: window (hash of its words), doc_id, th, many, start."""

    def rightwards(rows: pa.RecordBatch, reach: np.ndarray) -> pa.RecordBatch | None:
        before = np.array([len(x.as_buffer()) // 8 for x in rows.column("left")], np.int64)
        room = np.minimum(rows.column("room").to_numpy(), before + reach - least)
        some = np.flatnonzero(room >= 0)
        rows = rows.take(pa.array(some))
        return rows.set_column(3, "room", pa.array(room[some].astype(np.int32)))

    def leftwards(rows: pa.RecordBatch, reach: np.ndarray) -> pa.RecordBatch | None:
        out: list[list] = [[], [], [], []]
        room, places = rows.column("room").to_numpy(), rows.column("places")
        of, starts = [], []
        for i, (right, left) in enumerate(zip(rows.column("right"), rows.column("left"))):
            before = len(left.as_buffer()) // 8
            first = max(0, before - int(reach[i]))
            if first > room[i]:
                continue
            h = np.r_[np.frombuffer(left.as_buffer(), ">u8")[::-1], np.frombuffer(right.as_buffer(), ">u8")].astype(U)
            a = np.arange(first, room[i] + 1)
            window = _spans(h)(a, a + least).view(np.int64)
            for p in places[i].as_py():
                out[0].append(window)
                starts.append(a + p)
                of.append(np.full(len(a), i))
        if not of:
            return None
        of = pa.array(np.concatenate(of))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), *(rows.column(c).take(of) for c in ("doc_id", "th", "many")), pa.array(np.concatenate(starts).astype(np.int32))], names=["window", "doc_id", "th", "many", "start"])

    right = contexts.repartitionByRange("right", "left").sortWithinPartitions("right", "left")
    some = written(right.mapInArrow(lean(_beside("right", None, rightwards)), CONTEXT), "matches")
    left = some.repartitionByRange("key", "left", "right").sortWithinPartitions("key", "left", "right")
    out = written(left.mapInArrow(lean(_beside("left", "key", leftwards)), "window long, doc_id long, th long, many boolean, start int"), "windows")
    dropped(some)
    return out


def repeated_passages(docs: DataFrame, text: str = "text", least: int = 50, k: int = 10) -> DataFrame:
    """doc_id, th, start, stop, n_words, kept: the longest stretches of words made up of windows of `least` words that occur in another document too.

    Words are runs of characters other than space and 0x09-0x0D, compared as they are; start and stop count words from 0.
    A window is reported with kept = true wherever its first document has it, and with kept = false wherever another one does; stretches of
    either kind that touch or overlap are one row. First is the document with the smallest (doc_id, th), null before all ids; th is a digest of the
    document's words. Repeats inside one document alone don't count.
    Texts of fewer than `least` words, null and empty ones have no passages; very long ones are read whole. Rows with the same doc_id (or none) and
    the same words are one document; rows that share an id and differ are documents of their own. An empty table gives no rows. Other
    columns are not looked at, whatever their names. Needs k <= least; every window of `least` words is covered.
    """
    return _passages(docs, text, least, k)[0]


def _passages(docs: DataFrame, text: str, least: int, k: int) -> tuple[DataFrame, DataFrame]:
    """repeated_passages(), and the table of doc_id, th and dg of all rows."""
    found = _suffixes(docs, text, least, k)
    doc = F.col("doc_id") if _unique(found) else F.struct("doc_id", "th")
    flat = found.select("doc_id", "th", F.inline(F.arrays_zip("key", "whole", "pos", "lo", "hi"))).withColumn("doc", doc)
    classes = flat.groupBy("key", "whole").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    per = classes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("f"), F.max("last").alias("l")).where(~F.col("f").eqNullSafe(F.col("l"))).select("key", "kinds")
    shared = written(classes.join(per, "key").select("key", "whole", "first", (~F.col("first").eqNullSafe(F.col("last"))).alias("many"), (F.col("kinds") > 1).alias("beside")), "shared")
    rows = flat.join(shared, ["key", "whole"]).withColumn("own", F.col("doc").eqNullSafe(F.col("first")))
    members = written(rows.where("many OR beside").select("doc_id", "th", "key", "whole", "pos", "lo", "hi", "many", "own", "beside"), "members")
    contexts = _contexts(docs, text, members.where("own AND beside"), found, least)
    windows = _windows(contexts, least)
    looked = windows.withColumn("doc", doc)
    firsts = looked.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("many").alias("more")).where(F.col("more") | ~F.col("first").eqNullSafe(F.col("last"))).select("window", "first")
    kind = lambda own: F.when(own, 0).otherwise(1).alias("kind")
    told = looked.join(firsts, "window").select("doc_id", "th", kind(F.col("doc").eqNullSafe(F.col("first"))), F.col("start").alias("lo"), F.col("start").alias("hi"))
    spans = members.where("many").select("doc_id", "th", kind(F.col("own")), "lo", "hi").union(told)
    rows = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "lo", "hi")).alias("z")).select("doc_id", "th", F.col("z.kind").alias("kind"), F.col("z.lo").alias("lo"), F.col("z.hi").alias("hi"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, (kind, lo, hi) in enumerate(zip(batch.column("kind"), batch.column("lo"), batch.column("hi"))):
                kind, lo, hi = (np.array(x.as_py(), np.int64) for x in (kind, lo, hi))
                mark = np.zeros((2, int(hi.max()) + 2), np.int64)  # window starts that are kept, cut
                np.add.at(mark, (kind, lo), 1)
                np.add.at(mark, (kind, hi + 1), -1)
                mark = np.cumsum(mark, axis=1) > 0
                for which, starts in ((0, np.flatnonzero(mark[0] & ~mark[1])), (1, np.flatnonzero(mark[1]))):
                    if not len(starts):
                        continue
                    new = np.flatnonzero(np.r_[True, np.diff(starts) > least])
                    out[0] += [i] * len(new)
                    out[1] += starts[new].tolist()
                    out[2] += (starts[np.r_[new[1:], len(starts)] - 1] + least).tolist()
                    out[3] += [which == 0] * len(new)
            at = pa.array(out[0], pa.int64())
            start, stop = pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), start, stop, pa.array(np.array(out[2], np.int64) - np.array(out[1], np.int64)), pa.array(out[3], pa.bool_())], names=["doc_id", "th", "start", "stop", "n_words", "kept"])

    out = written(rows.mapInArrow(lean(joined), "doc_id long, th long, start long, stop long, n_words long, kept boolean"), "passages")
    dropped(shared, members, contexts, windows)
    ids = found.select("doc_id", "th", "dg")
    return out, ids


def without_repeats(docs: DataFrame, text: str = "text", least: int = 50, k: int = 10) -> DataFrame:
    """docs with every passage cut out of the text that an earlier document has (kept = false in repeated_passages()).

    Columns and rows stay; the other texts stay byte for byte. A cut takes the passage's words and the white space after them;
    a text that is nothing but repeats becomes empty. Null texts stay null. Texts are matched by doc_id and a digest, so rows that share an id, or have none, don't meet.
    """
    passages, ids = _passages(docs, text, least, k)
    cuts = passages.where("NOT kept").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("z")).alias("c")
    i = ids.distinct().alias("i")
    each = cuts.join(i, F.col("c.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("c.th") == F.col("i.th")))
    each = written(each.select(F.col("c.doc_id").alias("__cid"), F.col("i.dg").alias("__cdg"), F.col("c.th").alias("__th"), F.col("c.z.start").alias("__a"), F.col("c.z.stop").alias("__b")), "cuts")
    names = list(docs.columns)
    at = names.index(text)
    # rows that can't be in cuts stay where they are
    cell = lambda i, d: F.pmod(F.xxhash64(i, d), F.lit(1 << CELLS))
    cells = bitmap(each, cell(F.col("__cid"), F.col("__cdg")), "cells")
    src = docs.withColumn("__id", docs["doc_id"].cast("long")).withColumn("__dg", F.xxhash64(docs[text].cast("string")))
    src = with_bit(src, cell(F.col("__id"), F.col("__dg")), cells, "__may")
    some = src.where("__may").join(each.hint("merge"), F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__dg") == F.col("__cdg")), "left").select(*names, "__th", "__a", "__b")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = some.union(src.where("NOT __may").select(*names, none("__th", "long"), none("__a", "array<long>"), none("__b", "array<long>")))
    plan = both.select(*names, "__th", "__a", "__b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            touched = np.flatnonzero(batch.column("__th").is_valid().to_numpy(zero_copy_only=False))
            column = batch.column(at)
            if len(touched):
                some = batch.take(pa.array(touched))
                new, done = column.to_pylist(), 0
                for part in pieces(some, names[at]):
                    hashes, rows, start, _, off = words(part.column(at), lower=False)
                    th = _spans(hashes)(rows[:-1], rows[1:]).view(np.int64)
                    for j in range(len(part)):
                        i = touched[done + j]
                        if part.column("__th")[j].as_py() != th[j]:
                            continue
                        begin = np.r_[start[rows[j] : rows[j + 1]], off[j + 1] - off[j]]
                        raw = (new[i] or "").encode()
                        drop = np.zeros(len(raw), bool)
                        for x, y in zip(part.column("__a")[j].as_py(), part.column("__b")[j].as_py()):
                            drop[begin[x] : begin[y]] = True
                        new[i] = np.frombuffer(raw, np.uint8)[~drop].tobytes().decode().rstrip(" \t\n\v\f\r")
                    done += len(part)
                column = pa.array(new, column.type)
            yield pa.RecordBatch.from_arrays([column if c == at else batch.column(c) for c in range(len(names))], names=names)

    return plan.mapInArrow(lean(run), docs.schema)


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS a, unnest(list_transform(range(0, len(w) - 49), lambda a: md5(array_to_string(w[a + 1:a + 50], ' ')))) AS h FROM d WHERE len(w) >= 50),
g AS (SELECT h, min(doc_id) AS f FROM x GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT x.doc_id, a, x.doc_id = f AS kept FROM x JOIN g USING (h)),
p AS (SELECT *, lag(a) OVER (PARTITION BY doc_id, kept ORDER BY a) AS p FROM m),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR a - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kept ORDER BY a) AS k FROM p)
SELECT doc_id, min(a)::BIGINT AS start, (max(a) + 50)::BIGINT AS stop, (max(a) + 50 - min(a))::BIGINT AS n_words, kept FROM i GROUP BY doc_id, kept, k
"""
