import random
import zlib

from locusmill.llm import langid


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["tion", "the", "ing", "er", "st"], "bb": ["eau", "é", "ou", "ier", "ç"], "cc": ["sch", "ü", "ei", "ver", "ß"]}
    return [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), x) for i in range(n) for x in [rng.choice(sorted(parts))]]


def test_held_out_accuracy(spark):
    data = texts(900)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out())
    m = langid.fit(df.where("NOT held_out"))
    got = langid.predict(df, m, keep=["doc_id", "held_out", "lang"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (3, "123 $$$ ...", "bb"), (4, "thing the", "aa"), (5, "eau " * 50000, "bb"), (None, "thething", None), (4, "thing the", "aa")], "doc_id long, text string, lang string")
    m = langid.fit(df)
    assert m.langs == ["aa", "bb"]
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(df, m).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "bb"), (None, "aa")}
    assert langid.predict(df, m).count() == 7
    none = langid.fit(df.where("false"))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, none).collect()} == {("und", 0.0)}
    assert langid.predict(df.where("false"), m).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the thing", "aa", "x", 0.5)], "doc_id long, text string, lang string, lang_pred string, score double")
    r = langid.predict(df, langid.fit(df), keep=["doc_id", "lang_pred", "score"]).first()
    assert r.lang_pred == "aa"


def test_matches_plain_bayes(spark):
    import math
    from collections import Counter

    data = texts(60, 4)
    m = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    counts, seen = {}, Counter(x for _, _, x in data)
    for _, t, x in data:
        b, _, _ = langid._ngrams([t])
        counts.setdefault(x, Counter()).update(b.tolist())
    for _, t, _ in data[:10]:
        b, _, _ = langid._ngrams([t])
        logs = {x: math.log(seen[x] / 60) + sum(math.log((c[k] + 0.1) / (sum(c.values()) + 0.1 * langid.BUCKETS)) for k in b.tolist()) for x, c in counts.items()}
        names, scores = langid.score_batch(m, [t])
        best = max(sorted(logs), key=logs.get)
        assert names == [best] and abs(scores[0] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-6
