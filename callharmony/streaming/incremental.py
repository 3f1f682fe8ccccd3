"""The page loop as an incremental job over landed page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from callharmony.operators.audit import page_audit
from callharmony.plans.jobs import IncompleteFetch, harmonize
from callharmony.session import store_of
from callharmony.sinks.raw import land_raw_text
from callharmony.sinks.table import STORED_SCHEMA, CallTable
from callharmony.sources.envelopes import PAGE_COLUMNS, page_sizes, raw_rows
from callharmony.sources.landed import stream_page_files
from callharmony.sources.specs import SourceSpec

# A page as it is staged.
SIZED_SCHEMA = "dataset string, run_id string, page_seq int, body string, n bigint, has_rows boolean, truncated boolean, batch bigint"


def run_stream(
    spec: SourceSpec,
    landing: str,
    crosswalk: DataFrame,
    target: CallTable,
    checkpoint: str,
    lake: str | None = None,
    files_per_batch: int | None = None,
    allow_incomplete: bool = False,
) -> StreamingQuery:
    """Take up every page that has landed since the last call, then stop.

    Each batch stages its pages and their sizes below the checkpoint in one write, in a folder of its own, which
    a replay overwrites; its raw rows likewise. When no page is left, what was staged is harmonized at once and goes
    into the table in one upsert, so a batch costs little beside its own files. Rows carry their run and page number,
    so the result does not depend on the order in which files arrive, and pages that are added twice, after a crash,
    count once. A batch with a reply without rows stops the stream and is not kept, unless it is allowed.

    Page counts are kept below the checkpoint. When no page is left, the runs taken up so far
    are audited by them, and incomplete ones raise ``IncompleteFetch``, unless allowed: their
    rows are in the table, and a later call takes up what is missing. A checkpoint from before
    counts were kept lacks those of its first pages.
    """
    staged = f"{checkpoint}/pages"

    def add(pages: DataFrame, batch_id: int) -> None:
        path, seen = f"{staged}/batch={batch_id}", Observation()
        sized = page_sizes(pages, spec.envelope, [*PAGE_COLUMNS, "body"])
        sized.observe(seen, F.count_if(~F.col("has_rows")).alias("bad")).write.mode("overwrite").parquet(path)
        if seen.get["bad"] and not allow_incomplete:
            context, folder = store_of(pages.sparkSession, path)
            context.delete(folder, True)
            raise IncompleteFetch(f"{seen.get['bad']} replies of batch {batch_id} have no rows")
        if lake is not None:
            rows = raw_rows(pages, spec.envelope)
            land_raw_text(rows, lake, spec.slug, f"stream/batch={batch_id}", mode="overwrite")

    pages = stream_page_files(target.spark, landing, spec.slug, files_per_batch)
    query = (
        pages.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        _add_staged(spec, crosswalk, target, checkpoint)  # also what was staged before a batch failed
    if not allow_incomplete:
        _refuse_incomplete(spec, target, f"{checkpoint}/page-counts")
    return query


def _add_staged(spec: SourceSpec, crosswalk: DataFrame, target: CallTable, checkpoint: str) -> None:
    """Keep the counts of all staged pages, by batch, and add their rows; what broke off can be repeated."""
    spark = target.spark
    context, pages = store_of(spark, f"{checkpoint}/pages")
    _, rows = store_of(spark, f"{checkpoint}/rows")
    if context.util().exists(pages):
        found = spark.read.schema(SIZED_SCHEMA).parquet(f"{checkpoint}/pages")
        sizes = found.drop("body").repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        sizes.partitionBy("batch").parquet(f"{checkpoint}/page-counts")
        # Folding reads its rows twice, so they are written once. A checkpoint of before may hold rows of its batches.
        harmonize(spec, found, crosswalk).write.mode("overwrite").parquet(f"{checkpoint}/rows/batch=-1")
    if context.util().exists(rows):
        target.add_pages(spark.read.schema(STORED_SCHEMA).parquet(f"{checkpoint}/rows"))
        context.delete(rows, True)
    if context.util().exists(pages):
        context.delete(pages, True)


def _refuse_incomplete(spec: SourceSpec, target: CallTable, counts: str) -> None:
    # A stream that has not seen any page has no counts.
    context, path = store_of(target.spark, counts)
    if not context.util().exists(path):
        return
    sizes = target.spark.read.parquet(counts).withColumn("run_id", F.coalesce("run_id", F.lit("")))
    judged = page_audit(sizes, spec.page_size, by=("dataset", "run_id")).where("NOT complete")
    row = judged.agg(F.count(F.lit(1)), F.min(F.struct("dataset", "run_id", "page_seq"))).first()
    if row[0]:
        raise IncompleteFetch(f"{row[0]} of the pages taken up are incomplete, the first is {tuple(row[1])}")
