"""Projection to a fixed schema: labels, typed nulls, renames with casts, column order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from callharmony.functions.casts import cast_to

FieldMapping = tuple[str, str, str, str]


def label(df: DataFrame, name: str) -> DataFrame:
    """Mark every row with the dataset it belongs to."""
    return df.withColumn("dataset", F.lit(name))


def fill_missing(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed nulls."""
    present = {name.lower() for name in df.columns}
    absent = {
        field.name: F.lit(None).cast(field.dataType)
        for field in schema
        if field.name.lower() not in present
    }
    return df.withColumns(absent) if absent else df


def map_fields(df: DataFrame, mappings: Iterable[FieldMapping]) -> DataFrame:
    """One projection from ``(source, source type, target, target type)`` entries.

    Names match in any letter case. A source column that is absent gives a typed null,
    and columns that are not listed are left out.
    """
    present = {name.lower() for name in df.columns}

    def project(source: str, source_type: str, target: str, target_type: str) -> Column:
        if source.lower() not in present:
            return F.lit(None).cast(target_type).alias(target)
        return cast_to(cast_to(F.col(source), source_type), target_type).alias(target)

    return df.select(*[project(*mapping) for mapping in mappings])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and with its types."""
    filled = fill_missing(df, schema)
    return filled.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
