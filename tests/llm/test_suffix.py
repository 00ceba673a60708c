import random

from conftest import rows  # noqa: F401
from helpers import WORD, repeated

from locusmill.llm import suffix


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    passages = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    docs = {}
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            w += [word() for _ in range(rng.randrange(0, 30))] + p[a:b]
        docs[i] = rng.choice([" ", "\n", " \t "]).join(w)
    docs[n] = " ".join(["x y"] * 60)
    docs[n + 1] = " ".join(["x y"] * 45) + " z"
    docs[n + 2], docs[n + 3], docs[n + 4] = "", docs[3], None
    docs[n + 5] = " ".join([docs[4]] * 3)
    return docs


def test_against_all_windows(spark):
    for seed in (1, 2, 3):
        docs = corpus(seed)
        df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(5)
        cut, kept, tokens, where = repeated(docs, 12)
        got = {True: {}, False: {}}
        for r in suffix.repeated_passages(df, least=12, k=5).collect():
            assert r.n_words == r.stop - r.start >= 12
            got[r.kept].setdefault(r.doc_id, set()).update(range(r.start, r.stop))
        assert got[False] == cut
        assert set(got[True]) == set(kept) and all(got[True][i] >= kept[i] for i in kept)
        assert all(x in where[i] for i, g in got[True].items() for x in g)
        new = {r.doc_id: r.text for r in suffix.without_repeats(df, least=12, k=5).collect()}
        for i, t in docs.items():
            if i in cut:
                assert WORD.findall(new[i]) == [w for k, w in enumerate(tokens[i]) if k not in cut[i]]
            else:
                assert new[i] == t


def test_default_needs_fifty_words(spark):
    p = " ".join(f"w{k}" for k in range(50))
    short = " ".join(f"v{k}" for k in range(49))
    df = spark.createDataFrame([(1, f"a {p} b"), (2, f"c {p} d"), (3, f"e {short} f"), (4, f"g {short} h")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.stop, r.kept) for r in suffix.repeated_passages(df).collect()) == [(1, 1, 51, True), (2, 1, 51, False)]


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, th long")
    assert suffix.repeated_passages(df).count() == 0 and suffix.without_repeats(df).count() == 0
    p = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, p, 1), (None, p, 2), (7, None, 3), (7, p + " é", 4)], "doc_id long, text string, th long")
    new = suffix.without_repeats(df)
    assert new.columns == ["doc_id", "text", "th"] and new.count() == 4
    assert sorted(len(WORD.findall(r.text or "")) for r in new.collect()) == [0, 1, 60, 60]
