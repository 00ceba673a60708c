"""Words and shingles of Arrow string columns as 64-bit hashes, in numpy over whole batches.

A word is a run of bytes other than space and 0x09-0x0D, which is what [^\\x20\\x09-\\x0D]+ matches:
UTF-8 never has those bytes inside a longer character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_GROUP = 1 << 20  # bytes hashed at a time


_settled: list[bool] = []


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: memory is given back as it sees fit
        return None


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, in a Python worker that gives memory back: workers outlive their tasks, and an executor's limit holds for what they keep, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        if libc and not _settled:
            libc.mallopt(-3, 1 << 20)  # arrays of 1 MB and more get pages of their own
            libc.mallopt(-1, 1 << 20)
            pa.set_memory_pool(pa.system_memory_pool())
            _settled.append(True)
        try:
            yield from work(batches)
        finally:
            if libc:
                libc.malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 places where rows begin (null counts as empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word; the n + 1 places where rows begin among them; start and end byte of every word within its row; the bytes' row starts.

    lower: A-Z are taken as a-z, other letters stay."""
    data, off = text_bytes(texts)
    n = len(data)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | begins[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | begins[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), U)
    cut = np.r_[np.unique(np.searchsorted(starts, np.arange(0, max(n, 1), _GROUP))), len(starts)]
    power = np.empty(0, U)
    for a, b in zip(cut[:-1], cut[1:]):
        if a == b:
            continue
        s, lens = starts[a:b], ends[a:b] - starts[a:b]
        piece = data[s[0] : ends[b - 1]]
        span = np.diff(np.r_[s, ends[b - 1]])
        at = np.arange(len(piece), dtype=np.int64) - np.repeat(s - s[0], span)
        if len(power) <= at.max():
            power = np.cumprod(np.full(int(at.max()) + 64, _ODD, U))
        term = np.where(solid[s[0] : ends[b - 1]], piece, 0).astype(U) * power[at]
        hashes[a:b] = mix(np.add.reduceat(term, s - s[0]) + lens.astype(U) * U(0xD6E8FEB86659FD93))
    rows = np.searchsorted(starts, off)
    own = np.repeat(off[:-1], np.diff(rows))
    return hashes, rows, starts - own, ends - own, off


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, from every position at which k words are left in the array."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _ODD
        out += hashes[j : j + n]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int):
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence is one; without words none."""
    hashes, rows, *_ = words(texts, lower=True)
    runs = runs_of(hashes, k)
    for a, b in zip(rows[:-1], rows[1:]):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield runs_of(hashes[a:b], b - a) ^ U(b - a)
        else:
            yield np.empty(0, U)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Slices of a batch with about `most` text bytes each, so that the arrays above stay small."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b
