"""Raw data as a table of the catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession

from callharmony.sinks.raw import raw_source_path


def _quoted(name: str) -> str:
    return ".".join("`{}`".format(part.replace("`", "``")) for part in name.split("."))


def _create(spark: SparkSession, name: str, path: str, columns: str, partitions: str = "") -> None:
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
    spark.sql(f"CREATE TABLE {_quoted(name)} ({columns}) USING json {partitions} LOCATION '{location}'")


def register_raw(spark: SparkSession, name: str, path: str, schema: str) -> None:
    """Make a folder of raw JSON readable as ``spark.table(name)``; dropping it keeps the files."""
    _create(spark, name, path, schema)


def register_raw_runs(spark: SparkSession, name: str, base: str, slug: str, schema: str) -> None:
    """Make all raw rows of a source one table, with a text column ``run_id`` that is its partition.

    The catalog holds the runs' folders, so a read of one run lists and reads that folder only. Call
    ``recover_runs`` after a new run has landed. Raw rows of streams lie a folder deeper and are not in it; read those
    with ``register_raw``.
    """
    _create(spark, name, raw_source_path(base, slug), f"{schema}, run_id STRING", "PARTITIONED BY (run_id)")
    recover_runs(spark, name)


def recover_runs(spark: SparkSession, name: str) -> None:
    """Let the table know the runs that are there now; folders that are gone leave it."""
    spark.sql(f"MSCK REPAIR TABLE {_quoted(name)} SYNC PARTITIONS")
