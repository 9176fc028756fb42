"""Numeric columns and null-aware aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Dirty text to double; what does not parse becomes null."""
    return F.trim(text).try_cast("double")


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, as double."""
    return F.bround(value.cast("double"), digits)


def signif(value: Column, digits: int = 2) -> Column:
    """Round to significant digits, half to even; zero and null stay."""
    power = (F.floor(F.log10(F.abs(value))) - (digits - 1)).cast("int")
    up = F.bround(value / F.pow(F.lit(10.0), power)) * F.pow(F.lit(10.0), power)
    down = F.bround(value * F.pow(F.lit(10.0), -power)) / F.pow(F.lit(10.0), -power)
    return F.when(value == 0, F.lit(0.0)).when(power >= 0, up).otherwise(down)


def strict_mean(value: Column) -> Column:
    """Mean that is null as soon as one input is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def strict_sum(value: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum across columns; null if any part is null."""
    return reduce(add, columns)


def richness(columns: Sequence[Column]) -> Column:
    """Number of columns above zero; null if any part is null."""
    return reduce(add, [(c > 0).cast("int") for c in columns])


def presence(value: Column) -> Column:
    """1 where positive; anything else is kept as it is."""
    return F.when(value > 0, F.lit(1.0)).otherwise(value)


def at_least_zero(value: Column) -> Column:
    """Negative values become 0; null stays null."""
    return F.when(value < 0, F.lit(0.0)).when(value >= 0, value)


def hash_unit(*keys: Column, seed: int = 0) -> Column:
    """Number in [0, 1) fixed by the keys and the seed: the same row draws the same number
    again when a lost task is run a second time."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed).cast("long")), 11)
    return bits / F.lit(float(1 << 53))
