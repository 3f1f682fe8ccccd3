"""Record counts and the check that a paged fetch is whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from callharmony.operators.upsert import has_null_key
from callharmony.schema import KEYS
from callharmony.session import workspace

# Pages per window partition. Running totals are built inside spans of this many pages
# and then across the spans, so no task sees all pages of a large source.
SPAN = 4096


def record_count(df: DataFrame) -> int:
    return df.count()


def call_metrics(keys: Sequence[str] = KEYS, among: Column | None = None) -> list[Column]:
    """Counts to ``observe`` on a write of canonical rows, so that they need no second pass; ``among`` picks rows."""
    among = F.lit(True) if among is None else among
    return [
        F.count_if(among).alias("records"),
        F.count_if(among & has_null_key(keys)).alias("null_keys"),
        F.count_if(among & F.col("call_type").isNotNull() & F.col("common_call_type").isNull()).alias("unmapped"),
    ]


def with_running_total(counts: DataFrame, by: Sequence[str] = ("dataset",), span: int = SPAN) -> DataFrame:
    """Add ``running``, ``next_seq`` and ``first_seq`` to one row per page with its count ``n``.

    The counts are written first, a few bytes per page, since they are used twice.
    """
    path = workspace(counts.sparkSession, "page-counts")
    counts.write.parquet(path)
    counts = counts.sparkSession.read.schema(counts.schema).parquet(path)
    spans = counts.withColumn("_span", F.floor(F.col("page_seq") / span))
    group = [*by, "_span"]
    across = Window.partitionBy(*by).orderBy("_span")
    totals = spans.groupBy(*group).agg(F.sum("n").alias("_n"), F.min("page_seq").alias("_first"))
    totals = totals.select(
        *group,
        F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lead("_first").over(across).alias("_next_span"),
        F.min("_first").over(across).alias("first_seq"),
    )
    within = Window.partitionBy(*group).orderBy("page_seq")
    return (
        spans.join(totals, group)
        .withColumn("running", F.col("_before") + F.sum("n").over(within))
        .withColumn("next_seq", F.coalesce(F.lead("page_seq").over(within), "_next_span"))
        .drop("_span", "_before", "_next_span")
    )


def page_counts(rows: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows per page and the running total, from rows that carry ``page_seq``."""
    counts = rows.groupBy(*by, "page_seq").agg(F.count(F.lit(1)).alias("n"))
    return with_running_total(counts, by).select(*by, "page_seq", "n", "running")


def page_audit(
    counts: DataFrame,
    page_size: int | None = None,
    by: Sequence[str] = ("dataset",),
) -> DataFrame:
    """Judge each page of a fetch by the rule that ends it.

    ``counts`` has one row per page: ``n`` and, where known, ``has_rows`` (false for a reply
    without a row array) and ``truncated`` (the service said there is more). A truncated page
    never ends a fetch; another one does or, with a ``page_size``, does if it holds fewer rows.
    A page is ``complete`` if it has a row array, directly precedes the next page, and ends
    the fetch if it is the last one; the others hold ``page_size`` rows or, without one, are
    truncated. Where ``more`` is known, a planned fetch has told whether others follow, and pages
    may have any size. The first page is number 0.
    """
    if "more" not in counts.columns:
        counts = counts.withColumn("more", F.lit(None).cast("boolean"))
    if "has_rows" not in counts.columns:
        counts = counts.withColumn("has_rows", F.lit(True))
    if "truncated" not in counts.columns:
        counts = counts.withColumn("truncated", F.lit(False))
    whole = ~F.coalesce(F.col("more"), F.col("truncated"), F.lit(False))
    is_short = F.coalesce(~F.col("more"), F.col("n") < page_size) if page_size is not None else whole
    is_last = F.col("next_seq").isNull()
    in_place = (F.col("page_seq") > F.col("first_seq")) | (F.col("page_seq") == 0)
    followed = is_last | (F.col("next_seq") == F.col("page_seq") + 1)
    return with_running_total(counts, by).select(
        *by,
        "page_seq",
        "n",
        "running",
        (F.col("running") - F.col("n")).alias("offset"),
        is_last.alias("is_last"),
        is_short.alias("is_short"),
        "has_rows",
        (F.col("has_rows") & in_place & followed & (is_last == is_short) & (whole | ~is_last)).alias("complete"),
    )


def audit_summary(audit: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """One row per fetch: its pages, its rows and whether every page is complete."""
    return audit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("records"),
        F.every("complete").alias("complete"),
    )
