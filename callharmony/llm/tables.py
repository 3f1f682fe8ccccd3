"""Helpers the operators share: written intermediate tables, checked broadcasts, clash-free names."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import callharmony
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callharmony.session import workspace

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library's code to the executors through Spark, once per application, as ``--py-files`` does."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(callharmony.__file__).parent
        bundle = Path(tempfile.mkdtemp(prefix="callharmony-code-")) / "callharmony.zip"
        with zipfile.ZipFile(bundle, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(bundle))
        _shipped.add(context.applicationId)


# A table is broadcast only after it was counted and found to have at most this many rows.
BROADCAST_ROWS = 20_000


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as Parquet in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    path = workspace(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where a count proves the bound; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, whatever the letter case."""
    used = {column.lower() for column in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """A column by its plain name, also where the name holds dots or spaces."""
    return df[f"`{name}`"]
