from collections import Counter

import public_tokenizers
from helpers import WORD, components, repeated
from tokenizers import Tokenizer

import corpus_pipeline
from locusmill.llm import langid, mixing

SF = "/root/testdata/sf0.001"


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    m = langid.fit(docs.where(~langid.held_out()))
    kept = {r.doc_id: r for r in docs.collect()}
    names, scores = langid.score_batch(m, [r.text or "" for r in kept.values()])
    kept = {i: r for (i, r), x, s in zip(kept.items(), names, scores) if x != "und" and s >= corpus_pipeline.LEAST_SCORE}
    one = components({i: r.text for i, r in kept.items()})
    kept = {i: r for i, r in kept.items() if one[i][1] == i}
    cut, _, tokens, _ = repeated({i: r.text for i, r in kept.items()})
    assert set(cut) or len(kept) > 0
    texts = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(list(kept.values()), docs.schema), SF).collect()}
    for i, r in kept.items():
        words = [w for k, w in enumerate(tokens[i]) if k not in cut.get(i, ())]
        assert WORD.findall(texts.get(i, "")) == words and (i in cut or texts[i] == r.text)
    mixed = spark.createDataFrame([(i, t, kept[i].source) for i, t in texts.items()], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(mixed).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter({(i, tuple(lib.encode(texts[i], add_special_tokens=False).ids)): n for i, n in copies.items() if n})
    assert got == want


def test_stages_return_documents_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert len(corpus_pipeline.STAGES) == 5
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.where("false"), SF).count() == 0


def test_null_and_shared_ids(spark):
    """Each group keeps one row of its own, whatever ids it shares, and the mix takes rows, not ids."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40 + k))
    data = [(None, text(1)), (None, text(2)), (None, text(3)), (3, text(4)), (5, text(4)), (5, text(5)), (7, text(6)), (7, text(7)), (None, text(7)), (9, text(8)), (9, text(8)), (None, text(9)), (None, text(9))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter([(None, text(1)), (None, text(2)), (None, text(3)), (3, text(4)), (5, text(5)), (7, text(6)), (7, text(7)), (9, text(8)), (None, text(9))])
    for n in (1, 5):
        got = corpus_pipeline.jaccard_join(spark, docs.repartition(n), SF)
        assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    # one source: its target is its own size, so every row is taken once
    got = corpus_pipeline.suffix_dedup(spark, got, SF)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    got = corpus_pipeline.mix_sources(spark, got, SF)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_odd_columns_ties_and_long_texts(spark):
    """Nulls in any column, further columns with clashing names, a very long text and ties: rows come through all stages, twice the same."""
    long = " ".join(f"word{j % 977} of{j}" for j in range(60_000))
    data = [(i, f"The quick brown fox number {i} jumps over the lazy dog and runs away from it in the end {'again ' * (i % 3)}", "en" if i % 5 else None, None if i % 7 == 0 else "s1", None, f"x{i}", i) for i in range(30)]
    data += [(None, None, None, None, None, None, None), (50, "", "en", "s2", 0, "e", 1), (51, long, "en", "s2", len(long), "l", 2), (None, long + " more of it", "en", "s2", 1, "m", 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string, row long")
    want = None
    for n in (1, 4):
        now = docs.repartition(n)
        for name, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, SF).cache()
            assert now.columns == docs.columns
            if name == "jaccard_join":
                assert now.where("doc_id = 51").count() == 1 and now.where("doc_id IS NULL AND text IS NOT NULL").count() == 0
        got = Counter((r.doc_id, r.text, r.score, r.row) for r in now.collect())
        assert want is None or got == want
        want = got
    assert want and all(t for _, t, _, _ in want)


def test_rows_without_an_id_do_not_meet(spark):
    """Null ids on many rows: joins are by row and digest, so their number doesn't grow with the square."""
    docs = spark.range(20_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('w', id % 7000, ' a b c d e f g h ', id % 7000) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert corpus_pipeline.jaccard_join(spark, docs, SF).count() == 7000
    assert corpus_pipeline.suffix_dedup(spark, docs, SF).count() == 20_000
