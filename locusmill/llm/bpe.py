"""BPE encoding and decoding by batched numpy merge rounds, and the exact length histogram that uses it.

The symbols of many distinct words lie in one flat array. A round looks every adjacent pair up by binary
search over the sorted pair keys, takes each word's lowest rank and merges all its places in the word at once,
from the left and without overlap. Words without a pair that has a rank are done.

Long words would need a round for each rank that occurs in them. So words are first cut where no token of the vocabulary can lie across (two bytes
that are no token, and with the byte before or after them in no token either), and pieces that stay long merge in one round every pair whose rank is the
lowest as far around it as a token can reach: nothing beyond that can change what it is merged with.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusmill.llm._words import lean, pieces

#: The pattern by which byte-level BPE splits text, and the bytes that stand for themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

NONE = np.int64(1 << 62)


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    letters, free = {b: chr(b) for b in PRINTABLE}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return letters


#: What the rest of a vocabulary file has to say, as nothing else is done here.
EXPECTED = {
    "normalizer": (None,), "model.type": ("BPE",), "model.dropout": (None, 0.0), "model.unk_token": (None,), "model.continuing_subword_prefix": (None, ""), "model.end_of_word_suffix": (None, ""),
    "model.byte_fallback": (None, False), "model.ignore_merges": (None, False), "pre_tokenizer.type": ("ByteLevel",), "pre_tokenizer.add_prefix_space": (False,), "pre_tokenizer.use_regex": (True, None), "decoder.type": ("ByteLevel",),
}
LONG = 512  # symbols of a piece that is merged by itself
HELD_WORDS, HELD_BYTES = 250_000, 16 << 20  # words remembered in a worker


def check(spec: dict) -> None:
    """Raises ValueError where the file asks for what the code doesn't do, rather than encode wrongly."""
    for path, fine in EXPECTED.items():
        value = spec
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value not in fine:
            raise ValueError(f"vocabulary file: {path} is {value!r}, expected one of {fine}")
    for t in spec.get("added_tokens", []):
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"vocabulary file: added token {t['content']!r} has flags that are not supported")


class Bpe:
    """A byte-level BPE vocabulary (the tokenizers library's JSON) as sorted arrays."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        check(spec)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.size = size
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        keep = np.r_[True, np.diff(keys[order]) > 0]  # a repeated pair keeps its first rank
        self.keys, self.ranks, self.made = keys[order][keep], order[keep].astype(np.int64), made[order][keep]
        said = [b""] * size
        for t, i in vocab.items():
            said[i] = bytes(back[c] for c in t if c in back) if i in set(self.added.values()) else bytes(back[c] for c in t)
        for t, i in self.added.items():
            said[i] = t.encode()
        self.said_len = np.array([len(x) for x in said], np.int64)
        self.said_at = np.cumsum(self.said_len) - self.said_len
        self.said = np.frombuffer(b"".join(said), np.uint8)
        tokens = [said[i] for i in sorted(set(made.tolist()))]
        self.token_bytes, self.token_len = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(x) for x in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.two = np.zeros(1 << 16, bool)
        self.two[[x[0] << 8 | x[1] for x in tokens if len(x) == 2]] = True
        x = self.token_bytes.astype(np.int64)
        inside = np.repeat(self.token_at + self.token_len, self.token_len) - np.arange(len(x)) >= 3
        at = np.flatnonzero(inside)
        three = np.zeros(1 << 24, np.uint8)
        three[x[at] << 16 | x[np.minimum(at + 1, len(x) - 1)] << 8 | x[np.minimum(at + 2, len(x) - 1)]] = 1
        self.three = np.packbits(three)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of pairs (NONE: no merge) and their places among the pair keys, found by binary search."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words, and parts of words across whose ends no token can lie, begin."""
        new = np.zeros(len(data), bool)
        new[starts] = True
        if len(data) > 2:
            x = data.astype(np.int64)
            over = self.two[x[:-1] << 8 | x[1:]]
            t = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
            three = (self.three[t >> 3] >> (7 - (t & 7))) & 1 > 0
            over[1:] |= three
            over[:-1] |= three
            new[1:] |= ~over
        return np.flatnonzero(new)

    def _alone(self, sym: np.ndarray, data: np.ndarray) -> np.ndarray:
        """One long piece: in a round all pairs that have the lowest rank as far around them as a token of these bytes can reach."""
        there = np.zeros(256, bool)
        there[data] = True
        own = np.logical_and.reduceat(there[self.token_bytes], self.token_at)
        reach = int(self.token_len[own].max(initial=2))
        rank, at = self._rank(sym[:-1], sym[1:])
        while len(rank):
            low = np.r_[np.full(reach, NONE), rank, np.full(reach, NONE)]
            have, wide = 1, 2 * reach + 1
            while have < wide:
                step = min(have, wide - have)
                low = np.minimum(low[: len(low) - step], low[step:])
                have += step
            hit = (rank == low) & (rank != NONE)
            # pairs in a row with one rank overlap: they are merged, every second one from the left, when all of them are hit
            first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            size = np.diff(np.r_[first, len(rank)])
            hit &= np.repeat(np.logical_and.reduceat(hit, first), size) & ((np.arange(len(rank)) - np.repeat(first, size)) % 2 == 0)
            go = np.flatnonzero(hit)
            if not len(go):
                break
            sym[go] = self.made[at[go]]
            changed, stay = np.zeros(len(sym), bool), np.ones(len(sym), bool)
            changed[go] = True
            stay[go + 1] = False
            old = np.flatnonzero(stay)
            sym, changed = sym[old], changed[old]
            rank, at = rank[old[:-1]], at[old[:-1]]
            dirty = np.flatnonzero(changed[:-1] | changed[1:])
            rank[dirty], at[dirty] = self._rank(sym[dirty], sym[dirty + 1])
        return sym

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and how many each has."""
        lens = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lens) - lens
        piece = self._pieces(data, starts)
        size = np.diff(np.r_[piece, len(data)])
        of_word = np.searchsorted(starts, piece, "right") - 1
        sym = self.first[data]
        word = np.repeat(np.arange(len(piece)), size)
        done_sym, done_word = [], []
        long = size > LONG
        for i in np.flatnonzero(long):
            made = self._alone(sym[piece[i] : piece[i] + size[i]].copy(), data[piece[i] : piece[i] + size[i]])
            done_sym.append(made)
            done_word.append(np.full(len(made), i))
        if long.any():
            short = ~long[word]
            sym, word = sym[short], word[short]
        while len(sym) > 1:
            rank, at = self._rank(sym[:-1], sym[1:])
            rank = np.where(word[:-1] == word[1:], rank, NONE)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NONE], start)
            spread = np.repeat(best, np.diff(np.r_[start, len(sym)]))
            hit = np.flatnonzero((rank == spread[:-1]) & (rank != NONE))
            open_ = spread != NONE
            if not len(hit):
                break
            # of hits in a row every second one goes, counted from the run's left end (pairs like aa in aaa)
            fresh = np.r_[True, (np.diff(hit) > 1) | (word[hit[1:]] != word[hit[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                stay &= open_
            sym, word = sym[stay], word[stay]
        done_sym.append(sym)
        done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(of_word[word], minlength=len(words))

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        flat, count = self.merged(raw)
        self.held += sum(map(len, raw))
        base = len(self.known)
        self.known.update(zip(new, range(base, base + len(new))))
        self.flat = np.concatenate([self.flat, flat])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])

    def words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words (in self.known; -1 - id for an added token) of all texts, and how many each text has."""
        if len(self.known) > HELD_WORDS or self.held > HELD_BYTES:
            self.forget()
        found, special = [], []
        for t in texts:
            if self.cut and any(a in t for a in self.added):
                parts = []
                for x in self.cut.split(t):
                    if x in self.added:
                        special.append((len(found), len(parts), self.added[x]))
                        parts.append("")
                    else:
                        parts += self.split.findall(x)
                found.append(parts)
            else:
                found.append(self.split.findall(t))
        new = {w for ws in found for w in ws if w not in self.known}
        new.discard("")
        for a in range(0, len(new := sorted(new)), 1 << 17):
            self._learn(new[a : a + (1 << 17)])
        get = self.known.get
        count = np.array([len(ws) for ws in found], np.int64)
        out = np.fromiter((get(w, -1) for ws in found for w in ws), np.int64, int(count.sum()))
        begin = np.cumsum(count) - count
        for row, at, i in special:
            out[begin[row] + at] = -1 - i
        return out, count

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        word, count = self.words_of(texts)
        many = np.ones(len(word), np.int64)
        many[word >= 0] = np.diff(self.begin)[word[word >= 0]]
        return np.diff(np.r_[0, np.cumsum(many)][np.r_[0, np.cumsum(count)]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and the n + 1 places where texts begin."""
        word, count = self.words_of(texts)
        known = word >= 0
        many = np.ones(len(word), np.int64)
        many[known] = np.diff(self.begin)[word[known]]
        end = np.cumsum(many)
        at = np.zeros(len(word), np.int64)
        at[known] = self.begin[word[known]]
        total = int(end[-1]) if len(end) else 0
        src = np.arange(total) + np.repeat(at - (end - many), many)
        ids = self.flat[np.minimum(src, max(len(self.flat) - 1, 0))] if len(self.flat) else np.zeros(total, np.int32)
        ids = ids.copy()
        ids[(end - many)[~known]] = (-1 - word[~known]).astype(np.int32)
        return ids, np.r_[0, end][np.r_[0, np.cumsum(count)]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the tokens stand for."""
        lens = self.said_len[ids]
        end = np.cumsum(lens)
        return self.said[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.said_at[ids] - (end - lens), lens)].tobytes()


_loaded: dict[int, Bpe] = {}


def _bpe(spec) -> Bpe:
    """One vocabulary for each Python worker; its words are kept over tasks."""
    if (k := spec.id if hasattr(spec, "id") else hash(spec.value)) not in _loaded:
        _loaded.clear()
        _loaded[k] = Bpe(spec.value)
    return _loaded[k]


def _spec(df: DataFrame, path: str):
    """The vocabulary file (about 2 MB, whatever the data), read on the driver and broadcast: executors need not see its path."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in pieces(batch, column, 1 << 20):
        yield part, [t or "" for t in part.column(column).to_pylist()]


ENCODED = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again and return both digests beside the columns `keep`.

    n_tokens; ids_sha256 over little-endian unsigned 32-bit ids; decoded_sha256 over the decoded text in UTF-8;
    with ids=True also ids, array<int>. Added tokens' strings in a text become their ids, nothing is added.
    A null text counts as empty: no tokens, digests of no bytes. Repeated rows stay rows of their own. Columns of
    the input named as results give way to the results; the caller picks the others with `keep`.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    spec = _spec(docs, path)
    extra = ids
    src = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], *T._parse_datatype_string(", ".join(f"{a} {b}" for a, b in ENCODED)).fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(spec)
        for batch in batches:
            for part, texts in _parts(batch, "__text"):
                got, at = bpe.encode(texts)
                cols = [part.column(c) for c in keep]
                rows = [got[a:b] for a, b in zip(at[:-1], at[1:])]
                cols.append(pa.array(np.diff(at), pa.int64()))
                cols.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows], pa.string()))
                cols.append(pa.array([hashlib.sha256(bpe.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in rows], pa.string()))
                if extra:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(x for x, _ in ENCODED), *(["ids"] if extra else [])])

    return src.mapInArrow(lean(run), schema)


def token_lengths(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and n_tokens of each whole text, however long (null and empty: 0).

    One row for each input row, repeated ones too; an empty table gives none. A column n_tokens of the input gives way to the result; other
    columns that aren't kept are not looked at, whatever their names."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != "n_tokens"]
    spec = _spec(docs, path)
    src = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(spec)
        for batch in batches:
            for part, texts in _parts(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(bpe.lengths(texts), pa.int64())], names=[*keep, "n_tokens"])

    return src.mapInArrow(lean(run), schema)


def length_histogram(lengths: DataFrame, by: list[str] | None = None, block: int = 4096) -> DataFrame:
    """Exact histogram of n_tokens with suffix sums: one row for each group of `by` and length.

    n_tokens, n_docs (of that length), docs_from (that long or longer), tokens_from (their tokens), docs_upto (that long or
    shorter), tokens_upto, truncated_total (tokens left when every document is cut at this length: tokens_upto plus length
    times the documents that are longer), quantile (docs_upto over all documents of the group).
    Null lengths count as 0. Lengths are pre-aggregated before the shuffle, and sums run over blocks of `block` lengths
    first and inside a block then, so no task ever holds more than a block or the list of blocks. An empty table gives no rows.
    """
    by = list(by or [])
    hist = lengths.groupBy(*by, F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = hist.withColumn("__block", F.floor(F.col("n_tokens") / block))
    blocks = hist.groupBy(*by, "__block").agg(F.sum("n_docs").alias("__docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("__tokens"))
    below = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(
        *by, "__block",
        zero(F.sum("__docs").over(below)).alias("__docs_below"), zero(F.sum("__tokens").over(below)).alias("__tokens_below"),
        F.sum("__docs").over(whole).alias("__docs_all"), F.sum("__tokens").over(whole).alias("__tokens_all"),
    )
    inside = Window.partitionBy(*by, "__block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("__d", F.sum("n_docs").over(inside)).withColumn("__t", F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside))
    same = F.lit(True)
    b = blocks.select(*[F.col(c).alias(f"__b_{i}") for i, c in enumerate([*by, "__block"])], *[c for c in blocks.columns if c not in (*by, "__block")])
    for i, c in enumerate([*by, "__block"]):
        same = same & hist[c].eqNullSafe(b[f"__b_{i}"])
    out = hist.join(b, same)
    out = out.withColumn("docs_upto", F.col("__docs_below") + F.col("__d")).withColumn("tokens_upto", F.col("__tokens_below") + F.col("__t"))
    return out.select(
        *[hist[c] for c in by], "n_tokens", "n_docs",
        (F.col("__docs_all") - F.col("docs_upto") + F.col("n_docs")).alias("docs_from"),
        (F.col("__tokens_all") - F.col("tokens_upto") + F.col("n_docs") * F.col("n_tokens")).alias("tokens_from"),
        "docs_upto", "tokens_upto",
        (F.col("tokens_upto") + F.col("n_tokens") * (F.col("__docs_all") - F.col("docs_upto"))).alias("truncated_total"),
        (F.col("docs_upto") / F.col("__docs_all")).alias("quantile"),
    )
