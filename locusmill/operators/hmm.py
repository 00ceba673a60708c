"""A hidden Markov model of window coverage: states Err, Dup, Hap and Col, trained by EM over chunks, decoded by posterior.

Chunks are rows with arrays of their windows, so a chunk is never larger than its planned length allows. A batch of chunks
runs forward and backward side by side in numpy; what leaves a batch is one vector of sufficient statistics, and those
are added up by Spark. Parameters live on the driver and go out with each iteration.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.functions import special as S

ERR, DUP, HAP, COL = range(4)
STATES = ("Err", "Dup", "Hap", "Col")
END = 1e-4  # probability that a chunk ends
PSEUDO = 1e-3
TRUNCATE_AT = 0.25  # of the haploid mean
LEAST_COUNT = 10
BIND = (0.1, 0.5, 1.0)  # means of Err, Dup and Hap in units of Hap's; Col's are 2, 3, ...

#: Window, least read fraction at contig ends and the published dependence on the window before, by kind of reads.
PRESETS = {
    "hifi": (16000, 0.95, [[0.753, 0.0, 0.236, 0.0], [0.0, 0.464, 0.440, 0.0], [0.527, 0.162, 0.010, 0.218], [0.0, 0.0, 0.041, 0.206]]),
    "ont-r9": (16000, 1.0, [[0.0, 0.0, 0.383, 0.0], [0.0, 0.800, 0.0, 0.0], [0.800, 0.0, 0.584, 0.0], [0.0, 0.0, 0.366, 0.374]]),
    "ont-r10": (8000, 0.8, [[0.684, 0.0, 0.478, 0.0], [0.0, 0.800, 0.017, 0.0], [0.006, 0.0, 0.722, 0.081], [0.0, 0.0, 0.366, 0.476]]),
}


@dataclass
class Model:
    kind: str  # gaussian, trunc_exp_gaussian or negative_binomial
    mean: np.ndarray  # regions x components, as below
    var: np.ndarray
    weight: np.ndarray
    theta: np.ndarray
    lam: np.ndarray
    rate: np.ndarray  # of the truncated exponential, by region
    end: np.ndarray
    trans: np.ndarray  # regions x 5 x 5; row 4 starts, column 4 ends
    alpha: np.ndarray  # 4 x 4
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # state of each component
    bind: np.ndarray = field(default_factory=lambda: np.zeros(0))
    max_high_mapq: float = 0.25
    min_high_mapq: float = 0.75
    read_length: int = 0  # 0: contig ends are like the rest
    min_read_fraction: float = 0.95
    loglik: list[float] = field(default_factory=list)


def create(kind: str, region_coverages: list[float], col_components: int = 2, alpha=None, deviation: float = 0.0, seed: int = 0, **options) -> Model:
    """A model before training: means are bound to the first region's coverage, other regions scaled by theirs."""
    if not 0 <= deviation <= 0.5:
        raise ValueError("the deviation must be from 0 to 0.5")
    if region_coverages[0] < 1:
        raise ValueError("the baseline coverage must be at least 1")
    rng = np.random.default_rng(seed)
    bind = np.r_[BIND, np.arange(col_components) + 2.0]
    owner = np.r_[ERR, DUP, HAP, np.full(col_components, COL)]
    base = region_coverages[0] * bind * rng.uniform(1 - deviation, 1 + deviation, len(bind))
    mean = np.outer(np.array(region_coverages) / region_coverages[0], base)
    weight = np.tile(np.r_[1.0, 1.0, 1.0, np.full(col_components, 1 / col_components)], (len(mean), 1))
    theta, lam = S.nb_from_mean(mean)
    trans = np.zeros((len(mean), 5, 5))
    trans[:, :4, :4] = (1 - END) / 4
    trans[:, :4, 4] = END
    trans[:, 4, :4] = 0.25
    n = len(mean)
    return Model(kind, mean, mean.copy(), weight, theta, lam, np.ones(n), mean[:, HAP] * TRUNCATE_AT, trans, np.zeros((4, 4)) if alpha is None else np.array(alpha, float), owner, bind, **options)


def chunks(windows: DataFrame) -> DataFrame:
    """contig, chunk, len and arrays win, start, end, x, mapq, clip, region of each chunk's windows in order. windows as of coverage.tumbling()."""
    cols = windows.columns
    pick = lambda c: F.col(c).cast("int").alias(c) if c in cols else F.lit(0).alias(c)
    w = F.struct("win", "start", "end", F.col("cov").cast("int").alias("cov"), pick("cov_mapq"), pick("cov_clip"), pick("region"))
    out = windows.groupBy("contig", "chunk").agg(F.sort_array(F.collect_list(w)).alias("w"), F.max("end").alias("c_end"))
    return out.select("contig", "chunk", "c_end", *[F.col(f"w.{a}").alias(b) for a, b in (("win", "win"), ("start", "start"), ("end", "end"), ("cov", "x"), ("cov_mapq", "mapq"), ("cov_clip", "clip"), ("region", "region"))])


def _components(m: Model, x, pre, region, beta) -> np.ndarray:
    """Probability of x under each component (last axis) for each state before (the axis ahead of it)."""
    x, pre, beta = x[..., None, None], pre[..., None, None], beta[..., None, None]
    alpha = m.alpha[:, m.owner]  # states before x components
    if m.kind == "negative_binomial":
        p = m.weight[region][..., None, :] * S.negative_binomial(x, m.theta[region][..., None, :], m.lam[region][..., None, :])
        return np.maximum(np.broadcast_to(p, (*p.shape[:-2], 4, p.shape[-1])), S.FLOOR)
    mean = ((1 - alpha) * m.mean[region][..., None, :] + alpha * pre) * beta
    p = np.maximum(m.weight[region][..., None, :] * S.gaussian(x, mean, m.var[region][..., None, :] * beta), S.FLOOR)
    if m.kind == "trunc_exp_gaussian":
        rate, end, b = m.rate[region][..., None], m.end[region][..., None], beta[..., 0]
        e = np.where(x[..., 0] <= end, rate / b * np.exp(-rate / b * x[..., 0]) / (1 - np.exp(-rate * end)), 0.0)
        p[..., 0] = e
    return p


def _valid(m: Model, x, mapq) -> np.ndarray:
    """Which states (and the end) the share of high-mapq reads allows."""
    share = mapq / (0.1 + x)
    out = np.ones((*x.shape, 5), bool)
    out[..., DUP] = share <= m.max_high_mapq
    out[..., COL] = share >= m.min_high_mapq
    return out


def run_batch(m: Model, batch: list[dict], contig_len: dict | None = None) -> list[dict]:
    """Forward and backward over chunks side by side. Each result has post (windows x 4), loglik, and the pieces for estimates."""
    n, t = len(batch), max(len(c["x"]) for c in batch)
    grid = lambda k, fill=0: np.array([np.r_[np.asarray(c[k], float), np.full(t - len(c["x"]), fill)] for c in batch])
    x, mapq, region = np.minimum(grid("x"), 250), grid("mapq"), grid("region").astype(int)
    size = np.array([len(c["x"]) for c in batch])
    here = np.arange(t)[None] < size[:, None]
    beta = np.ones((n, t))
    if m.read_length:
        middle = (grid("start") + grid("end")) / 2
        ends = np.array([float((contig_len or {}).get(c["contig"], c["c_end"])) for c in batch])[:, None]
        low = np.maximum(middle - m.read_length + 1, -(1 - m.min_read_fraction) * m.read_length)
        high = np.minimum(middle, ends - m.min_read_fraction * m.read_length)
        beta = np.maximum((high - low) / m.read_length, 0.25)
    pre = np.c_[np.zeros((n, 1)), x[:, :-1]]
    comp = _components(m, x, pre, region, beta)  # n, t, state before, component
    comp[:, 0] = _components(_unlinked(m), x[:, 0], pre[:, 0], region[:, 0], beta[:, 0])
    emit = np.stack([comp[..., m.owner == s].sum(-1) for s in range(4)], -1)  # n, t, before, state
    ok = _valid(m, x, mapq)
    trans = m.trans[region][..., :4, :]  # n, t, before, to
    allowed = trans * ok[..., None, :]
    step = (allowed / np.maximum(allowed.sum(-1, keepdims=True), 1e-300))[..., :4]
    change = np.c_[np.zeros((n, 1), bool), region[:, 1:] != region[:, :-1]]
    step = np.where(change[..., None, None], 1 / 5, step)
    both = step * emit  # probability of a step and what it emits
    f, b, scale = np.zeros((n, t, 4)), np.ones((n, t, 4)), np.ones((n, t))
    for i in range(t):
        now = m.trans[region[:, 0], 4, :4] * emit[:, 0, 0] if i == 0 else np.einsum("nb,nbs->ns", f[:, i - 1], both[:, i])
        total = now.sum(-1)
        on = here[:, i]
        if (total[on] < 1e-50).any():
            raise FloatingPointError("the model gives a window next to no probability")
        scale[:, i] = np.where(on, total, 1.0)
        f[:, i] = np.where(on[:, None], now / np.where(total > 0, total, 1.0)[:, None], f[:, i - 1] if i else 0)
    last = np.zeros((n, t, 4))
    last[np.arange(n), size - 1] = END / scale[np.arange(n), size - 1][:, None]
    b = last.copy()
    for i in range(t - 2, -1, -1):
        inner = np.einsum("nbs,ns->nb", both[:, i + 1], b[:, i + 1]) / scale[:, i][:, None]
        b[:, i] = np.where((i + 1 < size)[:, None], inner, last[:, i])
    out = []
    post = f * b * scale[..., None]
    post /= np.maximum(post.sum(-1, keepdims=True), 1e-300)
    for j in range(n):
        k = size[j]
        # expected steps from window i to i + 1; the first step is left out, as its emission isn't like the others'
        xi = f[j, 1 : k - 1, :, None] * both[j, 2:k] * b[j, 2:k, None, :] / END
        share = comp[j, 2:k] / np.maximum(emit[j, 2:k][..., m.owner], S.FLOOR)
        out.append({"post": post[j, :k], "loglik": float(np.log(scale[j, :k]).sum() + np.log(END)), "xi": xi, "share": share, "x": x[j, 2:k], "pre": pre[j, 2:k], "region": region[j, 2:k]})
    return out


def _unlinked(m: Model) -> Model:
    out = copy.copy(m)
    out.alpha = np.zeros((4, 4))
    return out


STATS = ("mean_n", "mean_d", "var_n", "var_d", "weight_n", "rate_n", "rate_d", "theta_n", "theta_d", "lam_n", "lam_d")


def statistics(m: Model, results: list[dict]) -> np.ndarray:
    """One vector: for each region the STATS of each component and the 4 x 4 steps; last the log-likelihood."""
    regions, comps = m.mean.shape
    st = {k: np.zeros((regions, comps)) for k in STATS}
    steps, loglik = np.zeros((regions, 4, 4)), 0.0
    alpha = m.alpha[:, m.owner]
    for r in results:
        loglik += r["loglik"]
        if not len(r["x"]):
            continue
        xi, reg = r["xi"], r["region"]
        np.add.at(steps, reg, xi)
        w = xi[..., m.owner] * r["share"]  # t, before, component
        adjusted = (r["x"][:, None, None] - alpha * r["pre"][:, None, None]) / (1 - alpha)
        z = (adjusted - m.mean[reg][:, None, :]) * (1 - alpha)
        for k, v in (("mean_n", w * adjusted), ("mean_d", w), ("var_n", w * z * z), ("var_d", w), ("weight_n", w), ("rate_n", w * r["x"][:, None, None]), ("rate_d", w)):
            np.add.at(st[k], reg, v.sum(1))
        if m.kind == "negative_binomial":
            nb_r = -m.lam / np.log(m.theta)
            table = np.stack([[S.digamma_table(nb_r[a, c]) for c in range(comps)] for a in range(regions)])  # regions, comps, x
            delta = nb_r[reg] * table[reg[:, None], np.arange(comps)[None], np.minimum(r["x"], 250).astype(int)[:, None]]
            wc = w.sum(1)
            beta = 1 - 1 / (1 - m.theta) - 1 / np.log(m.theta)
            for k, v in (("lam_n", wc * delta), ("lam_d", wc), ("theta_n", wc * delta * beta[reg]), ("theta_d", wc * (r["x"][:, None] - (1 - beta[reg]) * delta))):
                np.add.at(st[k], reg, v)
    return np.r_[np.concatenate([st[k].ravel() for k in STATS]), steps.ravel(), loglik]


def _kernel(m: Model, lens: dict, work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for a in range(0, len(rows), 32):
                yield from work(rows[a : a + 32], run_batch(m, rows[a : a + 32], lens))

    return run


def expect(data: DataFrame, m: Model, lens: dict | None = None) -> np.ndarray:
    """The sum of statistics() over all chunks. What comes to the driver is one vector, whatever the number of chunks."""

    def work(rows, results):
        v = statistics(m, results)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["i", "v"])

    rows = data.mapInArrow(_kernel(m, lens or {}, work), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    regions, comps = m.mean.shape
    out = np.zeros(regions * (comps * len(STATS) + 16) + 1)
    for r in rows:
        out[r.i] = r.v
    return out


def maximise(m: Model, total: np.ndarray, tol: float = 1e-3) -> tuple[Model, bool]:
    """The model after one step, and whether no parameter has moved by more than tol. Parameters that hold for several components are estimated together;
    a parameter with a count of LEAST_COUNT or less stays."""
    new = copy.deepcopy(m)
    regions, comps = m.mean.shape
    st = {k: total[i * regions * comps : (i + 1) * regions * comps].reshape(regions, comps) for i, k in enumerate(STATS)}
    steps = total[len(STATS) * regions * comps : -1].reshape(regions, 4, 4)
    settled = True

    def put(target: np.ndarray, at, value: float) -> None:
        nonlocal settled
        old = target[at]
        if old > 1e-4 and abs(value / old - 1) >= tol:
            settled = False
        target[at] = value

    def bound(target, top, low, r, use, coef) -> None:
        n, d = (top[r, use] / coef).sum(), low[r, use].sum()
        if d > LEAST_COUNT:
            for c, k in zip(use, coef):
                put(target, (r, c), n / d * k)

    for r in range(regions):
        free = np.arange(comps) if m.kind != "trunc_exp_gaussian" else np.arange(1, comps)
        if m.kind == "negative_binomial":
            bound(new.theta, st["theta_n"], st["theta_d"], r, free, np.ones(len(free)))
            bound(new.lam, st["lam_n"], st["lam_d"], r, free, m.bind[free])
            new.theta[r] = np.clip(new.theta[r], 1e-6, 1 - 1e-6)
        else:
            bound(new.mean, st["mean_n"], st["mean_d"], r, free, m.bind[free])
            bound(new.var, st["var_n"], st["var_d"], r, free, m.bind[free])
        for s in range(4):
            own = np.flatnonzero(m.owner == s)
            count = st["weight_n"][r, own].sum()
            if count > LEAST_COUNT and own[0] in free:
                for c in own:
                    put(new.weight, (r, c), st["weight_n"][r, c] / count)
        if m.kind == "trunc_exp_gaussian":
            n, d, end = st["rate_n"][r, 0], st["rate_d"][r, 0], m.end[r]
            if d > LEAST_COUNT:
                put(new.rate, r, S.golden_section(lambda q: d * np.log(q) - d * np.log(1 - np.exp(-q * end)) - n * q, 1e-9, max(end, 1e-6)))
            new.end[r] = new.mean[r, HAP] * TRUNCATE_AT
        counts = steps[r] + PSEUDO
        fresh = counts / counts.sum(1, keepdims=True) * (1 - END)
        old = m.trans[r, :4, :4]
        if ((old > 1e-6) & (np.abs(fresh / np.maximum(old, 1e-300) - 1) >= tol)).any():
            settled = False
        new.trans[r, :4, :4] = fresh
    new.loglik = [*m.loglik, float(total[-1])]
    return new, settled


def _vector(m: Model) -> np.ndarray:
    return np.concatenate([a.ravel() for a in (m.mean, m.var, m.weight, m.theta, m.lam, m.rate, m.end, m.trans)])


def _from_vector(m: Model, v: np.ndarray) -> Model:
    out, at = copy.deepcopy(m), 0
    for name in ("mean", "var", "weight", "theta", "lam", "rate", "end", "trans"):
        a = getattr(out, name)
        setattr(out, name, v[at : at + a.size].reshape(a.shape).copy())
        at += a.size
    out.weight = np.clip(out.weight, 1e-12, None)
    for s in range(4):
        own = out.owner == s
        out.weight[:, own] /= out.weight[:, own].sum(1, keepdims=True)
    out.trans[:, :4, :4] /= out.trans[:, :4, :4].sum(2, keepdims=True) / (1 - END)
    return out


def feasible(m: Model) -> bool:
    good = lambda a: bool(np.isfinite(a).all() and (a > 0).all())
    return good(m.mean) and good(m.var) and good(m.weight) and good(m.lam) and good(m.rate) and good(m.trans[:, :4, :4]) and bool((m.theta > 0).all() and (m.theta < 1).all())


def accelerated(data: DataFrame, m: Model, tol: float, lens: dict | None = None) -> tuple[Model, bool]:
    """A squared extrapolation of two EM steps: the step length is shortened until the model is feasible and no less likely than before."""
    one, a = maximise(m, expect(data, m, lens), tol)
    two, b = maximise(one, expect(data, one, lens), tol)
    v0, v1, v2 = _vector(m), _vector(one), _vector(two)
    r, v = v1 - v0, (v2 - v1) - (v1 - v0)
    length = min(-np.sqrt((r @ r) / max(v @ v, 1e-300)), -1.0)
    floor = two.loglik[-1]
    while length < -1.0001:
        trial = _from_vector(two, v0 - 2 * length * r + length * length * v)
        if feasible(trial):
            try:
                total = expect(data, trial, lens)
                if total[-1] >= floor:
                    return maximise(trial, total, tol)[0], a and b
            except FloatingPointError:
                pass
            except Exception as e:  # raised on an executor
                if "next to no probability" not in str(e):
                    raise
        length = (length - 1) / 2
    return two, a and b


def train(data: DataFrame, m: Model, iterations: int = 100, tol: float = 1e-3, accelerate: bool = False, lens: dict | None = None) -> Model:
    """EM until no parameter moves by more than tol. data: chunks(), best written or cached, as each iteration reads it."""
    for _ in range(iterations):
        m, settled = accelerated(data, m, tol, lens) if accelerate else maximise(m, expect(data, m, lens), tol)
        if settled:
            break
    return m


def decode(data: DataFrame, m: Model, lens: dict | None = None) -> DataFrame:
    """contig, chunk, win, start, end, pred and the posterior of each state: the likeliest state of each window, the first of equals."""
    def work(rows, results):
        for c, r in zip(rows, results):
            n = len(c["x"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c["contig"]] * n), pa.array([c["chunk"]] * n, pa.int64()), pa.array(c["win"], pa.int64()), pa.array(c["start"], pa.int64()), pa.array(c["end"], pa.int64()), pa.array(r["post"].argmax(1).astype(np.int32)), *[pa.array(r["post"][:, s]) for s in range(4)]],
                names=["contig", "chunk", "win", "start", "end", "pred", *[f"p_{s.lower()}" for s in STATES]],
            )

    return data.mapInArrow(_kernel(m, lens or {}, work), "contig string, chunk long, win long, start long, end long, pred int, " + ", ".join(f"p_{s.lower()} double" for s in STATES))


def emission_table(m: Model) -> list[tuple]:
    """(state, distribution, component, parameter, values by region), as the parameter files list them."""
    out = []
    for c, s in enumerate(m.owner):
        if s == ERR and m.kind == "trunc_exp_gaussian":
            out += [(STATES[s], "Truncated Exponential", 0, "Rate", m.rate.tolist()), (STATES[s], "Truncated Exponential", 0, "End", m.end.tolist())]
        elif m.kind == "negative_binomial":
            out += [(STATES[s], "Negative Binomial", c, p, getattr(m, a)[:, c].tolist()) for p, a in (("Theta", "theta"), ("Lambda", "lam"), ("Weight", "weight"))]
        else:
            out += [(STATES[s], "Gaussian", c, p, getattr(m, a)[:, c].tolist()) for p, a in (("Mean", "mean"), ("Var", "var"), ("Weight", "weight"))]
    return out


def transition_table(m: Model) -> list[tuple]:
    """(region, state, to Err, to Dup, to Hap, to Col, end)."""
    return [(r, name, *m.trans[r, s].tolist()) for r in range(len(m.trans)) for s, name in enumerate((*STATES, "Start"))]


def simulate(m: Model, windows: int, contigs: int = 1, seed: int = 0, region_run: int = 200) -> list[tuple[str, int, int, int, int]]:
    """(contig, window, coverage, region, state): observations drawn from a model, regions changing about every region_run windows."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(contigs):
        state, region, before = rng.choice(4, p=m.trans[0, 4, :4]), 0, 0.0
        for w in range(windows):
            if len(m.mean) > 1 and rng.random() < 1 / region_run:
                region = int(rng.integers(len(m.mean)))
            prior = state
            if w:
                p = m.trans[region, state, :4]
                state = int(rng.choice(4, p=p / p.sum()))
            own = np.flatnonzero(m.owner == state)
            k = int(rng.choice(own, p=m.weight[region, own] / m.weight[region, own].sum()))
            a = m.alpha[prior, state] if w else 0.0
            if m.kind == "negative_binomial":
                r = -m.lam[region, k] / np.log(m.theta[region, k])
                x = float(rng.negative_binomial(r, m.theta[region, k]))
            elif state == ERR and m.kind == "trunc_exp_gaussian":
                x = -np.log(1 - rng.random() * (1 - np.exp(-m.rate[region] * m.end[region]))) / m.rate[region]
            else:
                x = rng.normal((1 - a) * m.mean[region, k] + a * before, np.sqrt(m.var[region, k]))
            before = float(np.clip(np.round(x), 0, 250))
            out.append((f"ctg_{c}", w, int(before), region, int(state)))
    return out


def parameters_close(truth: Model, fitted: Model, tol: float = 0.1) -> bool:
    """Whether all parameters of the emissions differ by less than tol, relatively."""
    names = ("theta", "lam", "weight") if truth.kind == "negative_binomial" else ("mean", "var", "weight")
    return all(bool((np.abs(getattr(fitted, a) / getattr(truth, a) - 1) < tol).all()) for a in names)


def tune_alpha(score, trials: int = 50, seed: int = 0, free=((0, 0), (0, 2), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3))) -> tuple[np.ndarray, float]:
    """The best of random dependence matrices by score(alpha): a plain search where the usual tool would be Bayesian optimisation."""
    rng = np.random.default_rng(seed)
    best, top = np.zeros((4, 4)), float(score(np.zeros((4, 4))))
    for _ in range(trials):
        a = np.zeros((4, 4))
        for i, j in free:
            a[i, j] = round(float(rng.uniform(0, 0.8)), 3)
        s = float(score(a))
        if s > top:
            best, top = a, s
    return best, top
