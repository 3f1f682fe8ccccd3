"""A fetch as a plan of ranges, read in rounds until every range is whole.

A range is a run of row offsets, or of values of the source's order key. In a range of offsets each page begins where
the rows of the one before ended. In a range of keys a page is asked for as ``key > last ORDER BY key``, which costs a
service the same for every page, and no row is missed or sent twice when others are added in between. A range that
breaks off, or has more pages than planned, goes on in the next round from its last page; one of keys is split again.
What has landed is never asked for again, also not by a later call for the same run.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import callharmony
from callharmony.session import store_of
from callharmony.sources.http import key_request, page_request
from callharmony.sources.paged import Fetch, body_rows
from callharmony.sources.specs import SourceSpec

LANDED = "low long, high long, page int, body string, n long, upto long, whole boolean, error string"
# A row that is a page; told by the error, since that opens no bodies.
READ = "error IS NULL"
# Rows asked for at once; services grant as many or fewer.
REQUEST_ROWS = 50_000
# What a range of keys with more pages than planned is split into.
SPLIT = 4
# Planned rows that a task reads, of as many ranges as they make; and tasks a core, which come before that.
TASK_ROWS, TASKS_A_CORE = 16 * REQUEST_ROWS, 4


@dataclass(frozen=True)
class Range:
    """Rows from offset ``low`` on, before ``high``; or those with ``low < key <= high``. No ``high``: up to the end."""

    low: int
    high: int | None


@dataclass(frozen=True)
class Patience:
    """How often a request is tried, and how many seconds lie between; each pause is twice the one before."""

    tries: int = 3
    pause: float = 1.0


def offset_ranges(total: int | None, size: int, pages: int) -> list[Range]:
    """Ranges of whole pages; the last one is open, so that rows added meanwhile are read too."""
    starts = list(range(0, max(total or 0, 1), size * pages))
    return [Range(start, after) for start, after in zip(starts, [*starts[1:], None], strict=True)]


def key_ranges(lowest: int, highest: int, parts: int) -> list[Range]:
    """Ranges of equal width from the lowest to the highest key; the last one is open."""
    width = max(1, -(-(highest - lowest + 1) // max(parts, 1)))
    lows = list(range(lowest - 1, highest, width))
    return [Range(low, after) for low, after in zip(lows, [*lows[1:], None], strict=True)]


def _ask(spec: SourceSpec, part: Range, at: int, fetch: Fetch, patience: Patience, by_key: bool) -> tuple[str, list[dict], bool]:
    request = key_request(spec, at, part.high) if by_key else page_request(spec, at)
    for attempt in range(patience.tries):
        try:
            body = fetch(request)
            return body, *body_rows(spec, body)
        except Exception:
            if attempt + 1 == patience.tries:
                raise
            time.sleep(patience.pause * 2**attempt)
    raise ValueError("a request is tried at least once")


def _read(spec: SourceSpec, part: Range, fetch: Fetch, patience: Patience, by_key: bool, pages: int) -> Iterator[dict]:
    """The pages of one range, as far as the service gives them; a failure is a row of its own, and the last."""
    at, size = part.low, spec.page_size
    row = {"low": part.low, "high": part.high, "page": 0}
    while by_key is False or row["page"] < pages:
        try:
            body, rows, truncated = _ask(spec, part, at, fetch, patience, by_key)
            if by_key and rows:
                at = max(int(record[spec.key]) for record in rows)
            elif not by_key:
                at += len(rows)
        except Exception as failure:  # whatever a service or the way there may raise
            yield {**row, "body": None, "n": 0, "upto": at, "whole": False, "error": repr(failure)[:500]}
            return
        if by_key:
            # A service may grant fewer rows than asked, so only no rows, or the last key, end a range.
            whole = not rows or (part.high is not None and at >= part.high)
        else:
            whole = not rows or (part.high is not None and at >= part.high) or (part.high is None and not truncated and len(rows) < size)
        yield {**row, "body": body, "n": len(rows), "upto": at, "whole": whole, "error": None}
        if whole:
            return
        row["page"] += 1


def task_count(ranges: int, rows: int, cores: int) -> int:
    """Tasks for so many ranges of about ``rows`` rows: one each while all cores are not busy, then small ones share a task."""
    return min(ranges, max(-(-ranges // max(1, TASK_ROWS // max(1, rows))), TASKS_A_CORE * cores))


def read_ranges(
    spark: SparkSession, spec: SourceSpec, parts: list[Range], fetch: Fetch, patience: Patience, by_key: bool, pages: int
) -> DataFrame:
    """``LANDED`` rows of the given ranges. Small ranges share a task and its file; each still fails on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("low", pa.int64()), ("high", pa.int64()), ("page", pa.int32()), ("body", pa.string()), ("n", pa.int64()), ("upto", pa.int64()), ("whole", pa.bool_()), ("error", pa.string())]
        )
        for batch in batches:
            for low, high in zip(batch["low"].to_pylist(), batch["high"].to_pylist(), strict=True):
                for row in _read(spec, Range(low, high), fetch, patience, by_key, pages):
                    yield pa.RecordBatch.from_pylist([row], schema)

    tasks = task_count(len(parts), pages * (spec.page_size or REQUEST_ROWS), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(part.low, part.high) for part in parts], "low long, high long").repartition(tasks)
    # The package travels with the function, which is pickled here, so executors need no copy of it.
    cloudpickle.register_pickle_by_value(callharmony)
    try:
        return rows.mapInArrow(run, LANDED)
    finally:
        cloudpickle.unregister_pickle_by_value(callharmony)


def unfinished(landed: DataFrame, parts: list[Range], by_key: bool, pages: int) -> list[Range]:
    """What is left to read of ``parts`` after what has landed; one row per range comes to the driver."""
    seen = {
        (row["low"], row["high"]): row
        for row in landed.groupBy("low", "high").agg(
            F.max("upto").alias("upto"), F.bool_or("whole").alias("whole"), F.count("error").alias("errors"), F.max("page").alias("page")
        ).collect()
    }
    left = []
    for part in parts:
        row = seen.get((part.low, part.high))
        if row is None:
            left.append(part)
        elif not row["whole"]:
            rest = Range(row["upto"], part.high)
            if by_key and part.high is not None and not row["errors"] and rest.low + SPLIT < part.high:
                left += _split(rest)
            else:
                left.append(rest)
    return left


def _split(part: Range) -> list[Range]:
    width = -(-(part.high - part.low) // SPLIT)
    lows = list(range(part.low, part.high, width))
    return [Range(low, after) for low, after in zip(lows, [*lows[1:], part.high], strict=True)]


def fetch_ranges(
    spark: SparkSession,
    spec: SourceSpec,
    parts: list[Range],
    place: str,
    fetch: Fetch,
    patience: Patience = Patience(),
    by_key: bool = False,
    pages: int = 16,
    rounds: int = 20,
) -> DataFrame:
    """Land all pages of the planned ranges below ``place``; returns ``page_seq, body, n, more``.

    Each round is a folder of its own, and asks only for what no earlier round has landed; the plan itself is landed
    first, so that a later call goes on with it. After ``rounds`` rounds, or two in a row that land nothing, the last
    error is raised and the pages stay. Pages are numbered in the order of ranges; ``more`` says that others follow.
    """
    context, plan = store_of(spark, f"{place}/plan")
    if context.util().exists(store_of(spark, f"{place}/plan/_SUCCESS")[1]):
        parts = [Range(row["low"], row["high"]) for row in spark.read.schema("low long, high long").parquet(f"{place}/plan").collect()]
    else:
        spark.createDataFrame([(part.low, part.high) for part in parts], "low long, high long").coalesce(1).write.mode("overwrite").parquet(f"{place}/plan")
    folders = context.util().listStatus(store_of(spark, place)[1])
    begun = rounds_done = sum(status.getPath().getName().startswith("round=") for status in folders)
    left, idle = parts, 0
    for number in range(begun):  # each round's ranges follow from those before
        left = unfinished(_round(spark, place, number), left, by_key, pages)
    while left:
        number = rounds_done
        if number == begun + rounds or idle == 2:
            error = _rounds(spark, place, number).where("error IS NOT NULL").agg(F.max_by("error", "round")).first()[0]
            raise ConnectionError(f"{spec.slug}: {len(left)} of the planned ranges are not whole; {error}")
        # A round that was lost on its way left a folder without its pages, which this one takes the place of.
        left = sorted(left, key=lambda part: part.low)
        read_ranges(spark, spec, left, fetch, patience, by_key, pages).write.mode("overwrite").parquet(f"{place}/round={number}")
        rounds_done += 1
        got = _round(spark, place, number).where(READ).limit(1).count()
        idle = 0 if got else idle + 1
        left = unfinished(_round(spark, place, number), left, by_key, pages)
    # An empty page ends a range; only of a service without any rows it is kept.
    found = _rounds(spark, place, rounds_done).where(READ)
    found = found.where("n > 0") if found.where("n > 0").limit(1).count() else found.orderBy("low").limit(1)
    counts = found.groupBy("low", "round").agg(F.count(F.lit(1)).alias("count"))
    before = Window.orderBy("low", "round").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    first = counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    last = counts.agg(F.sum("count")).first()[0] - 1
    page_seq = (F.col("first") + F.col("page")).cast("int")
    return found.join(first, ["low", "round"]).select(page_seq.alias("page_seq"), "body", "n", (page_seq < last).alias("more"))


def _round(spark: SparkSession, place: str, number: int) -> DataFrame:
    return spark.read.schema(LANDED).parquet(f"{place}/round={number}")


def _rounds(spark: SparkSession, place: str, rounds: int) -> DataFrame:
    return spark.read.schema(LANDED + ", round int").option("basePath", place).parquet(*[f"{place}/round={i}" for i in range(rounds)])
