import math

import duckdb
import numpy as np
from conftest import rows

from locusmill.llm import ann, topk


def data(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    out = [(i, [float(x) for x in v[i]]) for i in range(n)]
    out += [(n + k, out[20][1]) for k in range(40)] + [out[3], (None, out[1][1]), (9000, None), (9001, [0.0] * dim), (9002, [math.nan] * dim), (9050, [math.inf] * dim), (9100, [None] * dim), (9150, []), (9200, [1.0, 2.0])]
    return out


def frame(spark, d):
    return spark.createDataFrame(d, "vec_id long, embedding array<float>")


def brute(d, k, every, score, zero=True):
    good = {(i, tuple(v)) for i, v in d if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}
    out = {}
    for i, q in good:
        if i % every == 0:
            s = sorted(((-score(q, v), j) for j, v in good if j != i and len(v) == len(q)))
            out[i] = [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return out


def whole(q, v):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v))


def test_exact(spark):
    d = data()
    want = sorted(x for r in brute(d, 5, 10, whole).values() for x in r)
    assert rows(topk.top_k(frame(spark, d), every=10)) == want
    assert rows(topk.top_k(frame(spark, d), every=10, shard=64)) == want
    big = [(i, [1e30 * (i + 1), 1.0]) for i in range(8)]
    assert all(r.score == (1 << 63) - 1 for r in topk.top_k(frame(spark, big), every=4).collect())
    assert topk.top_k(frame(spark, []), every=4).count() == 0


def test_many_and_few_survivors():
    rng = np.random.default_rng(3)
    flat = rng.integers(-4, 5, (1500, 4)).astype(float)  # bounds part nothing, ties are many
    steep = np.round(rng.normal(size=(1500, 12)) * np.geomspace(300, 1, 12)) * rng.choice([1.0, 40.0], (1500, 1))
    for v in (flat, steep, steep * 2.0**14):
        ids = rng.permutation(len(v))
        q, q_ids = v[::25], ids[::25]
        x, y, score = topk.search(q_ids, q, topk.Prepared(ids, v), 5, block=200)
        for r in range(len(q)):
            inner = sorted((-sum(int(a) * int(b) for a, b in zip(q[r], w)), int(i)) for i, w in zip(ids, v) if i != q_ids[r])
            assert sorted(zip((-score[x == r]).tolist(), y[x == r].tolist())) == inner[:5]


def test_exact_sql(spark):
    embeddings = frame(spark, [x for x in data() if x[0] not in (9100,)]).toPandas()
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    got = sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in con.execute(topk.SQL).fetchall())
    assert got == rows(topk.top_k(frame(spark, [x for x in data() if x[0] not in (9100,)])))


def test_recall_and_ties(spark):
    d = data(3000, 24, 1)
    inner = lambda q, v: sum(float(a) * float(b) for a, b in zip(q, v))
    exact = brute(d, 20, 60, inner, zero=False)
    for options in ({}, {"shard": 700}):
        got = {}
        for r in ann.nearest(frame(spark, d), every=60, **options).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(exact)
        hit = sum(len({j for _, j, _ in got[i]} & {j for _, _, j, _ in exact[i]}) for i in exact)
        assert hit / sum(map(len, exact.values())) >= 0.97
        for i, r in got.items():
            r.sort()
            assert [x[0] for x in r] == list(range(1, len(r) + 1))
            assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(r, r[1:]))
            v = dict((j, x) for j, x in d if j is not None)
            assert all(abs(s - inner(v[i], v[j])) < 1e-9 for _, j, s in r)


def test_few(spark):
    d = [(i, [float(i), 1.0]) for i in range(5)]
    assert ann.nearest(frame(spark, d), every=2).count() == 3 * 4
    assert ann.nearest(frame(spark, []), every=2).count() == 0


def test_recall_with_mixed_norms():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 32))[rng.integers(0, 40, 2500)] + 0.6 * rng.normal(size=(2500, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    q = v[:100]
    long = rng.normal(size=(1, 32))
    for w in (v, *(np.r_[v, long / np.linalg.norm(long) * 10.0**e] for e in (2, 4, 6, 8)), v * 10 ** rng.uniform(-2, 4, (len(v), 1)), v * np.where(rng.random((len(v), 1)) < 0.01, 1000, 1)):
        exact = np.argsort(-(q @ w.T), axis=1)[:, :20]
        got = ann.search(w, ann.build(w), q)
        hit = 0
        for i in range(len(q)):
            g = got[i][got[i] >= 0]
            assert len(set(g)) == len(g)
            hit += len(set(g[np.argsort(-(w[g] @ q[i]))[:20]]) & set(exact[i]))
        assert hit / exact.size >= 0.97


def test_scores_held_at_the_ends_of_a_long(spark):
    d = [(0, [1e30, 1.0]), (1, [-1e30, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])]
    got = topk.top_k(frame(spark, d).selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding"), k=1, every=4).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 2)]  # the products with 2 and 3 are both beyond a long


def test_very_large_components():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    exact = np.argsort(-(v[:60] @ v.T), axis=1)[:, :20]
    for by in (1e22, 1e200, 1e-30):
        got = ann.search(v * by, ann.build(v * by), v[:60] * by)
        assert np.mean([len(set(g[:20]) & set(e)) / 20 for g, e in zip(got, exact)]) >= 0.95
