"""Casts that give null, not an error, on values that do not fit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType


def cast_to(value: Column, dtype: str | DataType) -> Column:
    return value.try_cast(dtype)


def whole_number(text: Column) -> Column:
    """Integer from JSON number text; ``1``, ``1.0`` and ``1E3`` are all whole numbers."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
