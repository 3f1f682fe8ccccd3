"""Schemas shared by every source: the canonical call row and the landed page."""

from pyspark.sql.types import (
    BooleanType,
    DataType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def fields(*names: str, dtype: DataType) -> list[StructField]:
    return [StructField(name, dtype) for name in names]


# The canonical table, in its column order.
CALL_SCHEMA = StructType(
    [
        *fields("dataset", "call_id", dtype=StringType()),
        StructField("call_time", TimestampType()),
        *fields("call_type", "common_call_type", dtype=StringType()),
        *fields("emergency_category", "call_category", dtype=StringType()),
        *fields("disposition", "priority", "unit_type", dtype=StringType()),
        *fields("alcohol", "domestic_violence", "drug", "mental_health", dtype=BooleanType()),
    ]
)

# A call is identified by its dataset and the id its city gave it.
KEYS = ("dataset", "call_id")

# Which page a row came from. Later runs, then later pages, supersede earlier ones.
ORDER = ("run_id", "page_seq")

# The call-type dictionary.
CROSSWALK_SCHEMA = StructType(fields("dataset", "call_type", "common_call_type", dtype=StringType()))

# One response body as it was fetched.
PAGE_SCHEMA = StructType(
    [
        *fields("dataset", "run_id", dtype=StringType()),
        StructField("page_seq", IntegerType()),
        StructField("body", StringType()),
    ]
)
