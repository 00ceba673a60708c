import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locusmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Bpe(f.read()), Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_like_the_library(both, texts):
    own, lib = both
    ids, at = own.encode(texts)
    assert own.lengths(texts).tolist() == np.diff(at).tolist()
    for a, b, t in zip(at[:-1], at[1:], texts):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert own.decode(ids[a:b]).decode("utf-8", "replace") == lib.decode(want, skip_special_tokens=False)


def test_long_runs_and_special(both):
    own, lib = both
    for t in ("a" * 5001, " " * 3000 + "x", "<|endoftext|>" * 3 + "a<|endoftext|>", "ab" * 2000, "é" * 999, "\n\n \t x", "　 x  "):
        ids, _ = own.encode([t])
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_frame(spark, both):
    _, lib = both
    data = [(1, "Hello <|endoftext|> world", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"), (4, "wörd " * 3000, "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(df, PATH).collect()}
    want = set()
    for i, t, _ in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want and bpe.encode_decode(df, PATH).count() == 5
    assert [r.ids for r in bpe.encode_decode(df.where("doc_id = 1"), PATH, ids=True).collect()] == [lib.encode(data[0][1], add_special_tokens=False).ids]
    assert bpe.encode_decode(df.where("false"), PATH).count() == 0


def test_histogram(spark):
    rng = random.Random(2)
    lens = [rng.choice([0, 1, 5, 5, 17, 40, 41, 99]) for _ in range(300)]
    df = spark.createDataFrame([(x, "a" if k % 3 else None) for k, x in enumerate(lens)], "n_tokens long, g string")
    n = np.array(lens)
    for r in bpe.length_histogram(df, block=8).collect():
        x = r.n_tokens
        assert (r.n_docs, r.docs_from, r.tokens_from) == ((n == x).sum(), (n >= x).sum(), n[n >= x].sum())
        assert (r.docs_upto, r.tokens_upto, r.truncated_total, r["quantile"]) == ((n <= x).sum(), n[n <= x].sum(), np.minimum(n, x).sum(), (n <= x).mean())
    grouped = bpe.length_histogram(df, ["g"], block=8)
    assert sum(r.n_docs for r in grouped.where("g IS NULL").collect()) == 100
    assert rows(bpe.length_histogram(df.where("false"))) == []


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "abcABC0123456789+/", "0123456789", "ACGT", "ab", "a", "etaoin", "的一是不了", " "])
def test_long_words(both, letters):
    own, lib = both
    r = random.Random(letters)
    text = "".join(r.choice(letters) for _ in range(20_000))
    ids, _ = own.encode([text])
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids and own.decode(ids).decode() == text


def test_a_million_letters_take_seconds(both):
    import time

    own, _ = both
    r = random.Random(4)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    own.encode([text])
    assert time.time() - began < 20


def test_other_vocabularies_are_refused():
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for part, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"})):
        with pytest.raises(ValueError):
            bpe.check({**spec, part: value})
