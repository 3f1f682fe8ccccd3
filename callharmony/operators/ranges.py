"""Range predicates on a source's own time column."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

Bound = date | datetime | str | Column | None


def _bound(value: Bound) -> Column:
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    return value if isinstance(value, Column) else F.lit(value)


def apply_range(
    df: DataFrame,
    column: str | Column,
    low: Bound = None,
    high: Bound = None,
    half_open: bool = False,
) -> DataFrame:
    """Rows between two bounds, both included; ``None`` leaves a side open.

    A date bound means midnight at its start, so a closed upper date keeps only midnight
    of that day. ``half_open`` leaves the upper bound itself out, for ranges given as
    "up to the start of the next day". Rows with no time are outside every range.
    """
    return df.where(in_range(F.col(column) if isinstance(column, str) else column, low, high, half_open))


def in_range(value: Column, low: Bound = None, high: Bound = None, half_open: bool = False) -> Column:
    """The same as a condition; null for rows with no time."""
    inside = F.lit(True)
    if low is not None:
        inside = value >= _bound(low)
    if high is not None:
        inside &= value < _bound(high) if half_open else value <= _bound(high)
    return inside
