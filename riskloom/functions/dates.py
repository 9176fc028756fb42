"""Dates and day counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_day(value: Column, fmt: str | None = None) -> Column:
    """Date part of a date, timestamp or text; unparsable text becomes null."""
    if fmt is None:
        return value.try_cast("date")
    return F.to_date(F.try_to_timestamp(value, F.lit(fmt)))


def days_between(end: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``end``; negative when the end comes first."""
    return F.datediff(to_day(end), to_day(start))


def days_or(end: Column, start: Column, fallback: Column) -> Column:
    """Days between, or ``fallback`` when the start date is missing."""
    return F.when(start.isNull(), fallback).otherwise(days_between(end, start))
