"""Special functions and distributions in numpy (no scipy needed)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

FLOOR = 1e-40

#: Bernoulli terms of the asymptotic series of digamma, and the Lanczos coefficients (g = 7, n = 9) of lgamma.
DIGAMMA_SERIES = [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12]
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def lgamma(x) -> np.ndarray:
    """log |gamma| for positive x."""
    x = np.asarray(x, float) - 1
    total = np.full_like(x, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def digamma(x) -> np.ndarray:
    """Derivative of log gamma for positive x: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out = out - np.where(small, 1 / np.where(small, x, 1.0), 0.0)
        x = np.where(small, x + 1, x)
    inv = 1 / (x * x)
    series = np.zeros_like(x)
    for c in reversed(DIGAMMA_SERIES):
        series = (series + c) * inv
    return out + np.log(x) - 0.5 / x - series


def digamma_table(r: float, most: int = 250) -> np.ndarray:
    """digamma(r + x) - digamma(r) for x = 0 ... most, by its recurrence."""
    return np.r_[0.0, np.cumsum(1 / (r + np.arange(most)))]


def gaussian(x, mean, var) -> np.ndarray:
    return np.exp(-0.5 * (x - mean) ** 2 / var) / np.sqrt(2 * math.pi * var)


def truncated_exponential(x, rate, end) -> np.ndarray:
    x = np.asarray(x, float)
    return np.where((x >= 0) & (x <= end), rate * np.exp(-rate * x) / (1 - np.exp(-rate * end)), 0.0)


def exponential(x, rate) -> np.ndarray:
    x = np.asarray(x, float)
    return np.where(x < 0, 0.0, rate * np.exp(-rate * x))


def poisson(x, rate) -> np.ndarray:
    x = np.asarray(x, float)
    return np.exp(x * np.log(rate) - rate - lgamma(x + 1))


def negative_binomial(x, theta, lam) -> np.ndarray:
    """By theta and lambda = -r ln theta."""
    r = -lam / np.log(theta)
    x = np.asarray(x, float)
    return np.exp(lgamma(r + x) - lgamma(r) - lgamma(x + 1) + r * np.log(theta) + x * np.log1p(-theta))


def nb_from_mean(mean, ratio: float = 1.5):
    """theta and lambda of the distribution with this mean and variance mean * ratio."""
    theta = 1 / ratio
    r = np.asarray(mean, float) * theta / (1 - theta)
    return np.full_like(r, theta), -r * math.log(theta)


def golden_section(f: Callable[[float], float], a: float, b: float, tol: float = 1e-6) -> float:
    """Where f is highest between a and b."""
    ratio = (math.sqrt(5) - 1) / 2
    low, high = b - ratio * (b - a), a + ratio * (b - a)
    f_low, f_high = f(low), f(high)
    while b - a > tol:
        if f_low > f_high:
            b, high, f_high = high, low, f_low
            low = b - ratio * (b - a)
            f_low = f(low)
        else:
            a, low, f_low = low, high, f_high
            high = a + ratio * (b - a)
            f_high = f(high)
    return (a + b) / 2
