"""City call types to common codes, as a join with a small dictionary table."""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import DataFrame, SparkSession, functions as F

from callharmony.schema import CROSSWALK_SCHEMA
from callharmony.session import local_frame
from callharmony.sources.specs import SPECS

# Above this many rows a dictionary is joined without a broadcast hint.
BROADCAST_ROWS = 100_000


def _packaged() -> list[tuple[str, str, str]]:
    """The packaged dictionaries, one file per source, named by its slug."""
    rows = []
    folder = resources.files("callharmony") / "crosswalks"
    for spec in SPECS.values():
        if spec.has_crosswalk:
            lines = (folder / f"{spec.slug}.csv").read_text("utf-8").splitlines()
            pairs = csv.DictReader(line for line in lines if not line.startswith("#"))
            rows += [(spec.label, pair["call_type"], pair["common_call_type"]) for pair in pairs]
    return rows


def load_crosswalk(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The call-type dictionary: the packaged one, or CSV files at ``path``.

    The files have the header ``dataset,call_type,common_call_type``. Codes are trimmed.
    """
    if path is None:
        return crosswalk_of(spark, _packaged())
    raw = spark.read.csv(path, schema=CROSSWALK_SCHEMA, header=True, comment="#")
    size = raw.groupBy("dataset", "call_type").count().agg(F.sum("count"), F.count(F.lit(1))).first()
    return _checked(raw, rows=size[0] or 0, keys=size[1])


def crosswalk_of(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A dictionary from ``(dataset, call type, code)`` entries."""
    entries = [dict(zip(CROSSWALK_SCHEMA.names, row, strict=True)) for row in rows]
    frame = local_frame(spark, entries, CROSSWALK_SCHEMA)
    return _checked(frame, rows=len(rows), keys=len({row[:2] for row in rows}))


def _checked(raw: DataFrame, rows: int, keys: int) -> DataFrame:
    """Refuse a repeated key, so that the join cannot add rows; broadcast only what is small."""
    if rows != keys:
        raise ValueError(f"call-type dictionary has {rows} rows for {keys} call types")
    crosswalk = raw.withColumn("common_call_type", F.trim("common_call_type"))
    return F.broadcast(crosswalk) if rows <= BROADCAST_ROWS else crosswalk


def map_call_type(df: DataFrame, crosswalk: DataFrame, type_col: str) -> DataFrame:
    """Add ``common_call_type`` for the row's dataset and call type, null where there is none.

    The match is exact, letter case included.
    """
    lookup = crosswalk.select(
        F.col("dataset").alias("_lookup_dataset"),
        F.col("call_type").alias("_lookup_type"),
        "common_call_type",
    )
    matches = (F.col("dataset") == F.col("_lookup_dataset")) & (F.col(type_col) == F.col("_lookup_type"))
    return df.join(lookup, matches, "left").drop("_lookup_dataset", "_lookup_type")
