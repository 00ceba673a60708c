"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language are gathered over all training rows; the log-probability matrix (languages x buckets,
128 KB a language) is broadcast, and batches of texts are scored as sparse rows of bucket counts times that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm._words import lean, pieces

BUCKETS = 1 << 14
CHUNK = 1 << 10
ORDERS = (1, 2, 3)
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> the code point of its lower case if it is a letter, else a space."""
    if not _tables:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables.append(t)
    return _tables[0]


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of all texts, and which texts have a letter. Whatever is no letter counts as one space."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _letters()[code]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    space = code == 32
    stay = np.ones(len(code), bool)
    stay[1:] = ~(space[1:] & space[:-1]) | (row[1:] != row[:-1])
    code, row = code[stay].astype(np.uint64), row[stay]
    some = np.bincount(row[code != 32], minlength=len(texts)) > 0
    buckets, rows = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        h = code[: len(code) - n + 1].copy()
        for j in range(1, n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += code[j : len(code) - n + 1 + j]
        h += np.uint64(n)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        ok = row[: len(row) - n + 1] == row[n - 1 :]
        buckets.append((h >> np.uint64(50)).astype(np.int32)[ok])
        rows.append(row[: len(row) - n + 1][ok])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int32), some
    return np.concatenate(buckets), np.concatenate(rows), some


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, langs: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.langs, self.log_prob, self.prior = langs, log_prob, prior


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.1, most: int = 512) -> Model:
    """Learn from every row of docs whose text and lang are not null: no sample, so no bound on rows.

    Each task adds its texts up to one array a language; arrays are cut into chunks and summed as a stream by
    (language, chunk), so neither a frequent language nor many tasks fill one task's memory. What the driver gets is
    the matrix: 128 KB for each distinct lang, of which there may be `most` (64 MB); beyond that, which isn't a list of languages any more, a ValueError is raised.
    Texts are read whole; a table without labelled rows gives a model that has learned nothing. Repeated rows count as often as they are there.
    """
    src = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    if src.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages to learn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                said = part.column("lang").to_pylist()
                names = sorted(set(said))
                number = np.array([names.index(x) for x in said], np.int64)
                bucket, row, _ = _ngrams(part.column("text").to_pylist())
                got = np.bincount(number[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                docs_of = np.bincount(number, minlength=len(names))
                for k, x in enumerate(names):
                    sums[x] = sums[x] + got[k] if x in sums else got[k]
                    seen[x] = seen.get(x, 0) + int(docs_of[k])
        yield from _rows(sums, seen)

    def _rows(sums, seen):
        for x, s in sums.items():
            parts = [s[a : a + CHUNK].astype("<i8").tobytes() for a in range(0, BUCKETS, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(parts) + 1), pa.string()), pa.array([-1, *range(len(parts))], pa.int32()), pa.array([np.array([seen[x]], "<i8").tobytes(), *parts], pa.binary())], names=["lang", "chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for x, c, b in zip(*(batch.column(k).to_pylist() for k in ("lang", "chunk", "counts"))):
                v = np.frombuffer(b, "<i8")
                sums[x, c] = sums[x, c] + v if (x, c) in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "chunk", "counts"])

    kind = "lang string, chunk int, counts binary"
    rows = src.mapInArrow(lean(count), kind).repartition(F.col("lang"), F.col("chunk")).mapInArrow(lean(add), kind).collect()
    langs = sorted({r.lang for r in rows})
    at = {x: k for k, x in enumerate(langs)}
    total, seen = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for r in rows:
        v = np.frombuffer(r.counts, "<i8")
        if r.chunk < 0:
            seen[at[r.lang]] = v[0]
        else:
            total[at[r.lang], r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = v
    total += smooth
    log_prob = np.log(total) - np.log(total.sum(axis=1, keepdims=True)) if langs else total
    return Model(langs, np.ascontiguousarray(log_prob.T), np.log(seen / max(seen.sum(), 1)) if langs else seen)


def score_batch(model: Model, texts: list[str], group: int = 64) -> tuple[list[str], np.ndarray]:
    """Predicted lang and its posterior probability for each text."""
    names, scores = [], np.zeros(len(texts))
    for a in range(0, len(texts), group):
        some_texts = texts[a : a + group]
        bucket, row, some = _ngrams(some_texts)
        n = len(some_texts)
        if not model.langs:
            names += ["und"] * n
            continue
        dense = np.bincount(row.astype(np.int64) * BUCKETS + bucket, minlength=n * BUCKETS)
        at = np.flatnonzero(dense)  # sparse rows: where, how often
        owner, col = at // BUCKETS, at % BUCKETS
        part = model.log_prob[col] * dense[at][:, None]
        logs = np.tile(model.prior, (n, 1))
        if len(at):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            logs[owner[first]] += np.add.reduceat(part, first, axis=0)
        best = logs.argmax(axis=1)  # a tie goes to the lang that sorts first
        top = logs[np.arange(n), best]
        p = 1 / np.exp(logs - top[:, None]).sum(axis=1)
        names += [model.langs[b] if s else "und" for b, s in zip(best, some)]
        scores[a : a + n] = np.where(some, np.clip(p, 0, 1), 0.0)
    return names, scores


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score (posterior probability, 0 to 1) of each whole text, beside the columns `keep`.

    A text that is null or has no letter, and any text under a model that has learned nothing, gets `und` and score 0.
    Rows stay as they are, repeated or not. Only the text is looked at.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text"))
    schema = src.select(*keep, F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "__text", 1 << 19):
                names, scores = score_batch(m, [t or "" for t in part.column("__text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(lean(run), schema)
