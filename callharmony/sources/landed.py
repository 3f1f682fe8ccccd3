"""Reading landed response bodies, in batch and as a stream.

Two layouts: one file per page (``.../run_id=<id>/page-<seq>.json``, or a folder
``page_seq=<seq>``), and a page table in Parquet. The table is the one for large fetches:
a million pages are then some large files instead of a million small ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from callharmony.schema import PAGE_SCHEMA
from callharmony.sources.envelopes import DATASTORE, FEATURES, ROW_ARRAY, parse_body, unwrap

TABLE_SCHEMA = StructType([*PAGE_SCHEMA.fields, StructField("more", BooleanType())])

# How a landed path names its run and its page.
RUN_PATTERN = r"run_id=([^/]+)"
PAGE_PATTERN = r"page(?:-|_seq=)(\d+)"


def located(bodies: DataFrame, path: Column, body: Column, dataset: str | None) -> DataFrame:
    """Bodies as pages, their run and number taken from the path they were landed at."""
    return bodies.select(
        F.lit(dataset).cast("string").alias("dataset"),
        _first_group(path, RUN_PATTERN).alias("run_id"),
        _first_group(path, PAGE_PATTERN).cast("int").alias("page_seq"),
        body.alias("body"),
    )


def _located(bodies: DataFrame, dataset: str | None) -> DataFrame:
    return located(bodies, F.col("_metadata.file_path"), F.col("value"), dataset)


def _first_group(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def read_page_files(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Page files as ``PAGE_SCHEMA``; many files per task, each file one row."""
    return _located(spark.read.text(path, wholetext=True, recursiveFileLookup=True), dataset)


def stream_page_files(
    spark: SparkSession, path: str, dataset: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """The same files as a stream; the page number is in the path, not in the arrival order."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _located(reader.text(path, wholetext=True, recursiveFileLookup=True), dataset)


def _with_more(pages: DataFrame) -> Column:
    return F.col("more") if "more" in pages.columns else F.lit(None).cast("boolean").alias("more")


def land_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Keep response bodies as a page table, split by dataset and run."""
    pages.select(*PAGE_SCHEMA.names, _with_more(pages)).write.mode(mode).partitionBy("dataset", "run_id").parquet(path)


def replace_run(pages: DataFrame, path: str, dataset: str, run_id: str) -> None:
    """Keep the bodies of one run in its own folder of the page table, in place of what an earlier try left."""
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"run id {run_id!r} is no folder name")
    pages.select("page_seq", "body", _with_more(pages)).write.mode("overwrite").parquet(f"{path}/dataset={dataset}/run_id={run_id}")


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    """Pages with ``more``: whether others follow, where a planned fetch has told so, else null."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path).select(*TABLE_SCHEMA.names)


def read_feature_pages(spark: SparkSession, path: str, attrs_schema: str) -> DataFrame:
    """Rows of offset-paged feature replies, ``features[].attributes``."""
    parsed = parse_body(read_page_files(spark, path), FEATURES.schema(f"struct<{attrs_schema}>"))
    return unwrap(parsed, FEATURES.array_path, FEATURES.row_field, keep=["page_seq"])


def read_datastore_pages(spark: SparkSession, path: str, record_schema: str) -> DataFrame:
    """Rows of SQL datastore replies, ``result.records[]``."""
    parsed = parse_body(read_page_files(spark, path), DATASTORE.schema(f"struct<{record_schema}>"))
    return unwrap(parsed, DATASTORE.array_path, keep=["page_seq"])


def read_row_array(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Rows of replies that are one top-level array each."""
    bodies = read_page_files(spark, path).withColumn("body", ROW_ARRAY.text(F.col("body")))
    parsed = parse_body(bodies, ROW_ARRAY.schema(f"struct<{row_schema}>"))
    return unwrap(parsed, ROW_ARRAY.array_path, keep=["page_seq"])


def read_row_lines(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Rows of a top-level array that holds one row per line, read in splits.

    A single huge array cannot be split as JSON, but the services break the line after each
    row, so its lines can. A line that is not a whole row fails the job.
    """
    line = F.regexp_replace(F.trim("value"), r"^[\[,\s]+|[\],\s]+$", "")
    lines = spark.read.text(path).select(line.alias("body")).where(F.col("body") != "")
    parsed = parse_body(lines, f"struct<{row_schema}>", mode="FAILFAST")
    return parsed.select("parsed.*")
