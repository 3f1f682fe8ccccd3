"""Raw rows into the lake as JSON lines, one folder per source and run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def raw_source_path(base: str, slug: str) -> str:
    return f"{base.rstrip('/')}/data/{slug}"


def raw_path(base: str, slug: str, run_id: str) -> str:
    return f"{raw_source_path(base, slug)}/run_id={run_id}"


def land_raw(df: DataFrame, base: str, slug: str, run_id: str, mode: str = "append") -> str:
    """Write rows with their columns. Null fields are left out of the JSON."""
    path = raw_path(base, slug, run_id)
    df.write.mode(mode).json(path)
    return path


def land_raw_text(rows: DataFrame, base: str, slug: str, run_id: str, mode: str = "append") -> str:
    """Write rows that are already JSON text (one ``value`` column), with every field they had."""
    path = raw_path(base, slug, run_id)
    rows.write.mode(mode).text(path)
    return path
