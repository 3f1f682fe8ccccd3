"""A look at a frame: its schema and a few rows in full."""

from __future__ import annotations

from pyspark.sql import DataFrame


def preview(df: DataFrame, n: int = 5) -> None:
    df.printSchema()
    df.show(n, truncate=False, vertical=True)
