import math

import numpy as np
from conftest import rows

from locusmill.functions import special as S
from locusmill.operators import hmm as H
from locusmill.operators import mixture as X


def test_special():
    x = np.array([0.1, 0.5, 1.0, 3.7, 20.0, 300.0])
    assert np.allclose(S.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    assert abs(float(S.digamma(1.0)) + 0.5772156649015329) < 1e-10
    assert np.allclose(S.digamma_table(2.5, 50), S.digamma(2.5 + np.arange(51)) - S.digamma(2.5))
    assert abs(S.golden_section(lambda v: -(v - 2) ** 2, 0, 5) - 2) < 1e-5
    assert abs(S.negative_binomial(np.arange(400), *[float(a) for a in S.nb_from_mean(20.0)]).sum() - 1) < 1e-9


def plain(m, c):
    """Forward and backward as written down, one window at a time."""
    n = len(c["x"])
    em = np.zeros((n, 4, 4))
    for i in range(n):
        comp = H._components(m if i else H._unlinked(m), np.array([float(c["x"][i])]), np.array([float(c["x"][i - 1]) if i else 0.0]), np.array([c["region"][i]]), np.ones(1))[0]
        for s in range(4):
            em[i, :, s] = comp[:, m.owner == s].sum(1)
    def step(i):
        ok = H._valid(m, np.array(float(c["x"][i])), np.array(float(c["mapq"][i])))
        t = m.trans[c["region"][i], :4] * ok
        t = t / t.sum(1, keepdims=True)
        return np.full((4, 4), 0.2) if c["region"][i] != c["region"][i - 1] else t[:, :4]
    f = [m.trans[c["region"][0], 4, :4] * em[0, 0]]
    for i in range(1, n):
        f.append((f[-1][:, None] * step(i) * em[i]).sum(0))
    b = [np.full(4, H.END)]
    for i in range(n - 1, 0, -1):
        b.insert(0, (step(i) * em[i] * b[0][None]).sum(1))
    post = np.array(f) * np.array(b)
    return post / post.sum(1, keepdims=True), math.log(f[-1].sum() * H.END)


def test_forward_backward():
    rng = np.random.default_rng(3)
    for kind in ("gaussian", "trunc_exp_gaussian", "negative_binomial"):
        m = H.create(kind, [20.0, 30.0], 2, alpha=np.full((4, 4), 0.2) if kind == "gaussian" else None, max_high_mapq=0.9, min_high_mapq=0.1)
        batch = []
        for n in (7, 4, 9):
            x = rng.poisson(20, n)
            batch.append({"contig": "a", "chunk": 0, "c_end": n, "x": x.tolist(), "mapq": (x // 2).tolist(), "clip": [0] * n, "region": (np.arange(n) // 3 % 2).tolist(), "start": list(range(n)), "end": list(range(1, n + 1)), "win": list(range(n))})
        for c, r in zip(batch, H.run_batch(m, batch)):
            post, ll = plain(m, c)
            assert np.allclose(r["post"], post, atol=1e-9) and abs(r["loglik"] - ll) < 1e-8


def test_training_recovers(spark):
    truth = H.create("gaussian", [40.0], 2, max_high_mapq=10.0, min_high_mapq=-1.0)
    truth.trans[0, :4, :4] = np.array([[0.9, 0.03, 0.04, 0.03], [0.01, 0.9, 0.08, 0.01], [0.01, 0.02, 0.95, 0.02], [0.01, 0.02, 0.07, 0.9]]) * (1 - H.END)
    data = H.simulate(truth, 1500, contigs=4, seed=5)
    df = spark.createDataFrame([(c, 0, w, w, w + 1, x, x // 2, 0, r) for c, w, x, r, _ in data], "contig string, chunk long, win long, start long, end long, cov int, cov_mapq int, cov_clip int, region int")
    rows_ = H.chunks(df).cache()
    start = H.create("gaussian", [40.0], 2, deviation=0.2, seed=1, max_high_mapq=10.0, min_high_mapq=-1.0)
    m = H.train(rows_, start, iterations=12)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.loglik, m.loglik[1:]))
    assert np.allclose(m.mean[0, [1, 2]], [20, 40], rtol=0.1)
    fast = H.train(rows_, start, iterations=3, accelerate=True)
    assert fast.loglik[-1] >= m.loglik[2]
    states = {(c, w): s for c, w, _, _, s in data}
    right = [states[r.contig, r.win] == r.pred for r in H.decode(rows_, m).collect()]
    assert len(right) == 6000 and np.mean(right) > 0.85


def test_mixture(spark):
    rng = np.random.default_rng(1)
    x = np.clip(np.r_[rng.normal(30, 5.5, 60000), rng.normal(60, 7.7, 9000), rng.exponential(1.5, 5000), rng.normal(15, 3.9, 4000)].round(), 0, 250).astype(int)
    h = np.bincount(x)
    m = X.fit(np.arange(len(h)), h)
    assert abs(m.mean[1] - 30) < 1 and abs(m.weight.sum() - 1) < 1e-9
    nb = X.fit_negative_binomial(np.arange(len(h)), h)
    assert nb["aic"] < nb["bic"] and 0 < nb["theta"] < 1
    hist = spark.createDataFrame([(i, int(v)) for i, v in enumerate(h)], "cov long, bases long")
    t = {r.cov: r for r in X.probability_table(hist).collect()}
    assert t[0].error > 0.5 and t[30].haploid > 0.9 and t[70].collapsed > 0.9
    from pyspark.sql import functions as F

    g = X.probability_tables(hist.withColumn("w", F.lit(1)), "w")
    assert rows(g, "cov")[0] == (0,)
