"""Small scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_phred(q: Column) -> Column:
    """-10 ln(1 - 10^(-q / 10)): the natural logarithm, as marker scores use it."""
    return -10 * F.log(1 - F.pow(F.lit(10.0), -q / 10))


def marker_score(is_match: Column, q: Column) -> Column:
    """What a marker adds to its alignment's consistency: reverse_phred for a match, -q for a mismatch."""
    return F.when(is_match, -reverse_phred(q)).otherwise(-q.cast("double"))


def poisson_pdf(k: Column, rate: float) -> Column:
    return F.exp(k * F.log(F.lit(rate)) - F.lit(rate) - _log_factorial(k))


def _log_factorial(k: Column) -> Column:
    return F.when(k <= 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(2).cast("long"), F.greatest(k.cast("long"), F.lit(2))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double"))))


def normal_pdf(x: Column, mean: float, var: float) -> Column:
    return F.exp(-(x - mean) * (x - mean) / (2 * var)) / F.sqrt(F.lit(2 * 3.141592653589793 * var))


def truncated_exponential_pdf(x: Column, rate: float, end: float) -> Column:
    return F.when((x >= 0) & (x <= end), rate * F.exp(-rate * x) / (1 - F.exp(F.lit(-rate * end)))).otherwise(0.0)


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def n_split(s: Column) -> Column:
    """A sequence's parts between runs of N."""
    return F.filter(F.split(s, "[nN]+"), lambda x: x != "")


def file_extension(name: Column) -> Column:
    """The last extension; .gz keeps the one before it."""
    return F.regexp_extract(name, r"\.([^./]+(?:\.gz)?)$", 1)


def split_numbers(s: Column, delimiter: str = ",", kind: str = "long") -> Column:
    """Numbers of a delimited string; parts that are none become null."""
    return F.transform(F.split(F.regexp_replace(s, r"\s+", ""), delimiter), lambda x: x.try_cast(kind))


def argmax(x: Column) -> Column:
    """Place (from 0) of an array's largest value, the first of equals."""
    return F.array_position(x, F.array_max(x)) - 1


def negative_binomial(mean: Column, var: Column) -> dict[str, Column]:
    """theta = mean / var, r = mean * theta / (1 - theta), lambda = -r ln theta."""
    theta = mean / var
    r = mean * theta / (1 - theta)
    return {"theta": theta, "r": r, "lambda": -r * F.log(theta)}


def weighted_choice(u: Column, weights: list[float]) -> Column:
    """Place that a uniform number falls on when weights are laid end to end."""
    whole, out, edge = sum(weights), F.lit(len(weights) - 1), sum(weights)
    for k in range(len(weights) - 1, -1, -1):
        edge -= weights[k]
        out = F.when(u * whole < edge + weights[k], k).otherwise(out)
    return out
