"""Mixture models of a depth histogram, fitted on the driver: the histogram has at most a few thousand rows whatever the data.

Components: errors (truncated exponential or Poisson), false duplicates at half the haploid depth, haploid, and collapsed at 2, 3, ... times it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from locusmill.functions import special as S


@dataclass
class Mixture:
    error: str  # exponential or poisson
    weight: np.ndarray  # error, duplicated (if any), haploid, collapsed ...
    mean: np.ndarray  # of all but the error
    var: np.ndarray
    rate: float
    end: float
    factor: np.ndarray  # mean of each in units of the haploid's
    loglik: float = 0.0

    def densities(self, x: np.ndarray) -> np.ndarray:
        e = S.poisson(x, self.rate) if self.error == "poisson" else S.truncated_exponential(x, self.rate, self.end)
        return np.stack([e, *[S.gaussian(x, m, v) for m, v in zip(self.mean, self.var)]], 1) * self.weight

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        d = self.densities(np.asarray(x, float))
        total = d.sum(1, keepdims=True)
        fallback = np.eye(d.shape[1])[np.where(np.asarray(x, float) < self.mean[self.factor == 1][0], 0, d.shape[1] - 1)]
        return np.where(total > 0, d / np.where(total > 0, total, 1), fallback)


def fit(cov, bases, duplicated: str = "bound", collapsed: int = 4, error: str = "exponential", iterations: int = 200, tol: float = 1e-6) -> Mixture:
    """EM on a histogram. duplicated: none; bound (its mean is half the haploid's); or free (put back to half where it leaves 0.25 to 0.75)."""
    x, n = np.asarray(cov, float), np.asarray(bases, float)
    inner = x > 0
    mode = float(x[inner][np.argmax(n[inner])]) if inner.any() and n[inner].max() > 0 else max(float(np.average(x, weights=n)), 1.0)
    factor = np.r_[[] if duplicated == "none" else [0.5], 1.0, np.arange(collapsed) + 2.0]
    k = len(factor) + 1
    m = Mixture(error, np.full(k, 1 / k), mode * factor, np.maximum(mode * factor, 1.0), 1.0, max(0.25 * mode, 1.0) if error == "exponential" else np.inf, factor)
    bound = np.ones(len(factor), bool)
    if duplicated == "free":
        bound[0] = False
    before = -np.inf
    for _ in range(iterations):
        d = np.maximum(m.densities(x), 1e-300)
        r = d / d.sum(1, keepdims=True) * n[:, None]
        m.loglik = float((np.log(d.sum(1)) * n).sum())
        if abs(m.loglik - before) <= tol * abs(m.loglik):
            break
        before = m.loglik
        w = r.sum(0)
        m.weight = w / w.sum()
        g, wg = r[:, 1:], w[1:]
        base = (g[:, bound] * x[:, None] / factor[bound]).sum() / max(wg[bound].sum(), 1e-300)
        spread = (g[:, bound] * (x[:, None] - base * factor[bound]) ** 2 / factor[bound]).sum() / max(wg[bound].sum(), 1e-300)
        m.mean, m.var = base * factor, np.maximum(spread * factor, 1e-3)
        if duplicated == "free":
            own = (g[:, 0] * x).sum() / max(wg[0], 1e-300)
            own = own if 0.25 * base <= own <= 0.75 * base else 0.5 * base
            m.mean[0], m.var[0] = own, max((g[:, 0] * (x - own) ** 2).sum() / max(wg[0], 1e-300), 1e-3)
        if error == "poisson":
            m.rate = max((r[:, 0] * x).sum() / max(w[0], 1e-300), 1e-3)
        else:
            m.end = max(0.25 * base, 1.0)
            inside = x <= m.end
            a, b = (r[inside, 0] * x[inside]).sum(), r[inside, 0].sum()
            if b > 0:
                m.rate = S.golden_section(lambda q: b * np.log(q) - b * np.log(1 - np.exp(-q * m.end)) - a * q, 1e-6, 50.0)
    return m


def fit_negative_binomial(cov, bases, components: int = 4, iterations: int = 300, tol: float = 1e-6) -> dict:
    """NB mixture (factors 0.1, 0.5, 1, 2, ...) with bound parameters by EM: theta, lam, weight, loglik, aic, bic."""
    x, n = np.asarray(cov, float), np.asarray(bases, float)
    factor = np.r_[0.1, 0.5, 1.0, np.arange(max(components - 3, 0)) + 2.0][:components]
    inner = x > 0
    mode = float(x[inner][np.argmax(n[inner])]) if inner.any() else 1.0
    theta, lam = S.nb_from_mean(mode * np.ones(1))
    theta, lam = float(theta[0]), float(lam[0])
    weight, before, loglik = np.full(len(factor), 1 / len(factor)), -np.inf, -np.inf
    for _ in range(iterations):
        d = np.stack([w * S.negative_binomial(x, theta, lam * f) for w, f in zip(weight, factor)], 1) + S.FLOOR
        loglik = float((np.log(d.sum(1)) * n).sum())
        if abs(loglik - before) <= tol * abs(loglik):
            break
        before = loglik
        r = d / d.sum(1, keepdims=True) * n[:, None]
        weight = r.sum(0) / r.sum()
        size = -lam * factor / np.log(theta)
        delta = size * (S.digamma(size[None] + x[:, None]) - S.digamma(size)[None])
        beta = 1 - 1 / (1 - theta) - 1 / np.log(theta)
        lam = float((r * delta / factor).sum() / r.sum())
        theta = float(np.clip(beta * (r * delta).sum() / (r * (x[:, None] - (1 - beta) * delta)).sum(), 1e-6, 1 - 1e-6))
    free, total = len(factor) + 1, n.sum()
    return {"theta": theta, "lam": lam, "weight": weight, "factor": factor, "loglik": loglik, "aic": 2 * free - 2 * loglik, "bic": free * np.log(total) - 2 * loglik}


COMPONENTS = ["error", "duplicated", "haploid", "collapsed"]


def probability_table(hist: DataFrame, **options) -> DataFrame:
    """cov, freq, fit, error, duplicated, haploid, collapsed: a row for each depth of the histogram (cov, bases)."""
    rows = sorted((int(r[0]), float(r[1])) for r in hist.select("cov", "bases").collect())
    x, n = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    m = fit(x, n, **options)
    p, d = m.probabilities(x), m.densities(x).sum(1) * n.sum()
    at = 1 if len(m.factor) and m.factor[0] == 0.5 else 0
    dup = p[:, 1] if at else np.zeros(len(x))
    out = [(int(a), float(b), float(c), float(e), float(u), float(h), float(k)) for a, b, c, e, u, h, k in zip(x, n, d, p[:, 0], dup, p[:, 1 + at], p[:, 2 + at :].sum(1))]
    return hist.sparkSession.createDataFrame(out, "cov long, freq double, fit double, error double, duplicated double, haploid double, collapsed double")


def probability_tables(hist: DataFrame, by: str, **options) -> DataFrame:
    """probability_table() for each group of hist (by, cov, bases), fitted where the group's rows are: one histogram a task at a time."""
    import pandas as pd

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cov")
        m = fit(pdf["cov"].to_numpy(), pdf["bases"].to_numpy(), **options)
        p = m.probabilities(pdf["cov"].to_numpy())
        at = 1 if len(m.factor) and m.factor[0] == 0.5 else 0
        return pd.DataFrame({by: key[0], "cov": pdf["cov"].to_numpy(), "error": p[:, 0], "duplicated": p[:, 1] if at else 0.0, "haploid": p[:, 1 + at], "collapsed": p[:, 2 + at :].sum(1)})

    kind = hist.schema[by].dataType.simpleString()
    return hist.groupBy(by).applyInPandas(one, f"{by} {kind}, cov long, error double, duplicated double, haploid double, collapsed double")
