"""Annotation sets as bits: annotation k > 0 is bit k - 1; 0 stands for no annotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(index: int | Column) -> Column:
    if isinstance(index, int):
        return F.lit(1 << (index - 1) if index else 0).cast("long")
    return F.when(index > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (index - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def flags(indices: Column) -> Column:
    """Bits of an array of indices."""
    return F.aggregate(indices, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(flag(i)))


def indices(bits: Column, most: int = 58) -> Column:
    """Indices of set bits, ascending; [0] if there are none."""
    found = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: F.call_function("getbit", bits, i - 1) == 1)
    return F.when(bits == 0, F.array(F.lit(0))).otherwise(found)


def overlaps(bits: Column, index: Column | int) -> Column:
    """Whether a segment belongs to annotation `index`: its bit, or for 0 that there are no bits; for null or -1 false."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.coalesce(F.when(i == 0, bits == 0).when(i > 0, bits.bitwiseAND(flag(i)) != 0), F.lit(False))


def lowest(bits: Column) -> Column:
    """Index of the lowest set bit, counted from 0; -1 without bits."""
    return F.when(bits == 0, F.lit(-1)).otherwise(F.bit_count(bits.bitwiseAND(-bits) - 1).cast("int"))
