"""The jobs: landed pages of a source to rows of the table of calls."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from callharmony.functions import whole_number
from callharmony.operators.audit import call_metrics, page_audit
from callharmony.operators.crosswalk import map_call_type
from callharmony.operators.project import conform, label
from callharmony.operators.ranges import in_range
from callharmony.operators.upsert import fold_pages
from callharmony.schema import CALL_SCHEMA, KEYS, ORDER
from callharmony.session import require_utc, store_of, workspace
from callharmony.sinks.jdbc import staging_sql, upsert_sql, write_jdbc
from callharmony.sinks.raw import land_raw_text
from callharmony.sinks.table import STORED_SCHEMA, CallTable, page_order
from callharmony.sources.envelopes import PAGE_COLUMNS, page_sizes, parse_rows, raw_rows
from callharmony.sources.fetching import REQUEST_ROWS, Patience, fetch_ranges, key_ranges, offset_ranges
from callharmony.sources.http import http_fetch, key_request, total_rows
from callharmony.sources.landed import read_page_table, replace_run
from callharmony.sources.paged import Fetch, body_rows
from callharmony.sources.specs import SourceSpec


@dataclass(frozen=True)
class RunReport:
    """How many buckets of the table were written, and counts taken while the rows were."""

    buckets: int
    records: int
    null_keys: int
    unmapped: int
    time_rejects: int
    out_of_range: int
    pages: int
    bad_pages: int


# A canonical row, and what was found against it.
JUDGED_SCHEMA = StructType(
    [*STORED_SCHEMA, StructField("reasons", ArrayType(StringType())), StructField("refused", BooleanType()), StructField("sent", StringType())]
)
REJECTED = ("dataset", "call_id", *ORDER, "reasons", "refused", "sent")


class IncompleteFetch(RuntimeError):
    """Pages are missing, or a reply has no rows; nothing was written."""


def harmonize(
    spec: SourceSpec, pages: DataFrame, crosswalk: DataFrame, rejects: Observation | None = None
) -> DataFrame:
    """Canonical rows of a source's pages, with the run and page they came from.

    One pass with no shuffle: parse, filter, project, look the call type up. Fields the
    source does not have are typed nulls. Rows outside the source's range are left out, rows
    whose time is missing or cannot be read stay with a null time. ``rejects`` counts times
    that were sent but could not be read, and rows out of range.
    """
    return judge(spec, pages, crosswalk, rejects).where("NOT refused").select(*STORED_SCHEMA.names)


def judge(spec: SourceSpec, pages: DataFrame, crosswalk: DataFrame, rejects: Observation | None = None) -> DataFrame:
    """Every row of a source's pages as ``harmonize`` gives it, with what was found against it.

    ``reasons`` holds ``out_of_range``, ``unreadable_time`` and ``unreadable_flag`` (sent, but a null in the canonical
    row), in this order, or nothing. ``refused`` rows, those out of range, are not for the table. ``sent`` is a JSON
    text of the fields as they were sent, for rows with a reason. All come from the one parse.
    """
    require_utc(pages.sparkSession)
    rows = parse_rows(pages, spec.envelope, spec.fields, spec.aliases, keep=ORDER)
    rows = rows.withColumn("_time", spec.time.source_time())
    outside = F.lit(False)
    if spec.time_range is not None:
        bounds = spec.time_range
        outside = ~F.coalesce(in_range(F.col("_time"), bounds.low, bounds.high, bounds.half_open), F.lit(True))
    unread = spec.time.rejected(F.col("_time"))
    if rejects is not None:
        rows = rows.observe(rejects, F.count_if(unread).alias("time_rejects"), F.count_if(outside).alias("out_of_range"))

    flags = {target: whole_number(F.col(source)).cast("boolean") for target, source in spec.flags.items()}
    bad_flags = [F.col(spec.flags[target]).isNotNull() & flag.isNull() for target, flag in flags.items()]
    bad_flag = reduce(lambda a, b: a | b, bad_flags, F.lit(False))
    found = {"out_of_range": outside, "unreadable_time": unread, "unreadable_flag": bad_flag}
    reasons = F.array_compact(F.array(*[F.when(condition, F.lit(reason)) for reason, condition in found.items()]))

    fields: dict[str, Column] = {"call_time": spec.time.call_time(F.col("_time"))}
    fields |= {target: F.col(source) for target, source in spec.texts.items()}
    fields |= flags
    fields |= {
        "reasons": reasons,
        "refused": outside,
        "sent": F.when(outside | unread | bad_flag, F.to_json(F.struct(*spec.fields))),
    }
    # A reply that is not paged is one batch, in however many bodies it was landed.
    page = F.col("page_seq") if spec.paged else F.lit(0)
    rows = rows.select("run_id", page.alias("page_seq"), *[c.alias(name) for name, c in fields.items()])
    rows = label(rows, spec.label)
    if spec.has_crosswalk:
        rows = map_call_type(rows, crosswalk, "call_type")
    return conform(rows, JUDGED_SCHEMA)


def audit(spec: SourceSpec, pages: DataFrame) -> DataFrame:
    """Whether the pages of each run are all there, by the source's own rule for the last page."""
    keep = [*PAGE_COLUMNS, *(name for name in ("more",) if name in pages.columns)]
    sizes = page_sizes(pages, spec.envelope, keep)  # one pass over the bodies; what follows reads the written counts
    if "part" in pages.columns:  # a page that was cut into several bodies
        sizes = sizes.groupBy(*PAGE_COLUMNS).agg(
            F.sum("n").alias("n"), F.every("has_rows").alias("has_rows"), F.bool_or("truncated").alias("truncated")
        )
    return page_audit(sizes, spec.page_size, by=("dataset", "run_id"))


def complete_pages(sources: Mapping[SourceSpec, DataFrame], allow_incomplete: bool = False) -> tuple[int, int]:
    """The numbers of pages and of pages that fail their audit; any of the latter is refused unless allowed."""
    judged = [audit(spec, pages).select("dataset", "run_id", "page_seq", "complete") for spec, pages in sources.items()]
    row = _union(judged).agg(F.count(F.lit(1)), F.count_if(~F.col("complete")), F.min(F.when(~F.col("complete"), F.struct("dataset", "run_id", "page_seq")))).first()
    if row[1] and not allow_incomplete:
        raise IncompleteFetch(f"{row[1]} of {row[0]} pages are incomplete, the first is {tuple(row[2])}")
    return row[0], row[1]


def fetch_pages(
    spark: SparkSession,
    spec: SourceSpec,
    landing: str,
    run_id: str,
    fetch: Fetch = http_fetch,
    allow_incomplete: bool = False,
    total: int | None = None,
    pages_per_task: int = 16,
    patience: Patience = Patience(),
) -> DataFrame:
    """Read a service on the executors, keep its bodies as a page table, and return those of this run.

    The rows are planned as ranges, of the source's order key where it has one, else of offsets, and each range is
    read by a task of its own, in requests of at most ``REQUEST_ROWS`` rows. Pages land as they come: a request that
    fails is tried again, a range that fails goes on in a later round, and a call that fails can be repeated for the
    same run, which asks only for what is missing. A repeated fetch of a whole run takes the place of the earlier one.
    A fetch with fewer rows than the service counted is refused before it takes a place among the landed runs, unless
    allowed.
    """
    asked = replace(spec, page_size=min(spec.page_size or REQUEST_ROWS, REQUEST_ROWS))
    counted = total_rows(spec, fetch) if total is None else None
    rows = total if total is not None else counted
    by_key, parts = False, offset_ranges(rows, asked.page_size, pages_per_task)
    if spec.key and rows:
        ends = [body_rows(spec, fetch(key_request(replace(spec, page_size=1), None, last=last)))[0] for last in (False, True)]
        if all(ends):
            low, high = (int(found[0][spec.key]) for found in ends)
            by_key, parts = True, key_ranges(low, high, -(-rows // (asked.page_size * pages_per_task)))
    place = f"{landing.rstrip('/')}-fetching/{spec.slug}/{run_id}"
    pages = fetch_ranges(spark, asked, parts, place, fetch, patience, by_key, pages_per_task)
    got = pages.agg(F.sum("n")).first()[0] or 0
    short = counted is not None and got < counted and not allow_incomplete
    if not short:
        replace_run(pages, landing, spec.slug, run_id)
    context, path = store_of(spark, place)
    context.delete(path, True)  # nothing of it is missing, so a repeated call begins anew
    if short:
        raise IncompleteFetch(f"{spec.slug}: {got} rows were sent, the service counted {counted}")
    landed = read_page_table(spark, landing)
    return landed.where((F.col("dataset") == spec.slug) & (F.col("run_id") == run_id))


def run(
    spec: SourceSpec,
    pages: DataFrame,
    crosswalk: DataFrame,
    target: CallTable,
    lake: str | None = None,
    run_id: str | None = None,
    allow_incomplete: bool = False,
    rejected: str | None = None,
) -> RunReport:
    """One source: audit the pages, keep the raw rows, harmonize, fold the pages, upsert."""
    return run_all({spec: pages}, crosswalk, target, lake, run_id, allow_incomplete, rejected)


def run_all(
    sources: Mapping[SourceSpec, DataFrame],
    crosswalk: DataFrame,
    target: CallTable,
    lake: str | None = None,
    run_id: str | None = None,
    allow_incomplete: bool = False,
    rejected: str | None = None,
) -> RunReport:
    """Any number of sources in one upsert. Incomplete runs are refused before anything is written.

    With ``lake``, the raw rows are kept below it first, in the folder of ``run_id``; a
    repeated run replaces its own folder. Rows are staged as Parquet so that folding reads
    narrow columns and no JSON is parsed twice. With ``rejected``, the rows that ``judge`` has a reason against are kept
    below it as a second output of the staged rows, likewise by ``run_id``; ``read_rejected`` reads them. Of a source that replies in one batch, the
    last run that has a key gives all rows of it.
    """
    if run_id is None and (lake is not None or rejected is not None):
        raise ValueError("landing raw or rejected rows needs a run_id")
    n_pages, bad_pages = complete_pages(sources, allow_incomplete)
    if lake is not None:
        for spec, pages in sources.items():
            land_raw_text(raw_rows(pages, spec.envelope), lake, spec.slug, run_id, mode="overwrite")

    rejects = {spec.slug: Observation() for spec in sources}
    paged, whole = [], []
    for spec, pages in sources.items():
        rows = (harmonize if rejected is None else judge)(spec, pages, crosswalk, rejects[spec.slug])
        (paged if spec.paged else whole).append(rows)

    counts, batches, stagings, refusals = [], [], [], []
    stays = F.lit(True) if rejected is None else ~F.col("refused")
    for kind, frames in (("paged", paged), ("whole", whole)):
        if not frames:
            continue
        stagings.append(f"{kind}-" + "+".join(sorted(spec.slug for spec in sources if spec.paged == (kind == "paged"))))
        counts.append(Observation())
        runs = [F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run")]
        staged = target.stage(_union(frames), stagings[-1], counts[-1], [*call_metrics(among=stays), *runs])
        if rejected is not None:
            refusals.append(staged.where(F.size("reasons") > 0).select(*REJECTED))
            staged = staged.where(stays).select(*STORED_SCHEMA.names)
        span = {counts[-1].get["first_run"], counts[-1].get["last_run"]}
        # Within one run, a reply that is not paged has nothing to fold.
        one_batch = kind == "whole" and len(span) == 1
        batches.append(staged if one_batch else fold_pages(staged, KEYS, page_order(len(span))))
    if refusals:
        _union(refusals).write.mode("overwrite").parquet(_rejected_path(rejected, run_id))
    buckets = target.upsert(_union(batches))
    for staging in stagings:
        target.clear_staging(staging)

    def total(name: str) -> int:
        return sum(seen.get[name] for seen in counts)

    return RunReport(
        buckets=buckets,
        records=total("records"),
        null_keys=total("null_keys"),
        unmapped=total("unmapped"),
        time_rejects=sum(seen.get["time_rejects"] for seen in rejects.values()),
        out_of_range=sum(seen.get["out_of_range"] for seen in rejects.values()),
        pages=n_pages,
        bad_pages=bad_pages,
    )


def _rejected_path(base: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/run={run_id}"


def read_rejected(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """The rows a run had something against: where they came from, ``reasons``, ``refused`` and what was ``sent``."""
    schema = StructType([JUDGED_SCHEMA[name] for name in REJECTED])
    return spark.read.schema(schema).parquet(_rejected_path(base, run_id))


def run_to_warehouse(
    spec: SourceSpec,
    pages: DataFrame,
    crosswalk: DataFrame,
    url: str,
    target: str,
    staging: str,
    execute: Callable[[str], object],
    properties: dict[str, str] | None = None,
    lake: str | None = None,
    run_id: str | None = None,
    allow_incomplete: bool = False,
) -> dict[str, int]:
    """One source into a table of a JDBC warehouse, through a staging table of the run; returns its counts.

    Audited and landed like ``run``. Rows are written to the cluster's shared folder first, so
    that folding them does not parse the pages twice.
    """
    n_pages, bad_pages = complete_pages({spec: pages}, allow_incomplete)
    if lake is not None:
        if run_id is None:
            raise ValueError("landing raw rows needs a run_id")
        land_raw_text(raw_rows(pages, spec.envelope), lake, spec.slug, run_id, mode="overwrite")
    rejects, counts = Observation(), Observation()
    rows = harmonize(spec, pages, crosswalk, rejects)
    path = workspace(pages.sparkSession, spec.slug)
    rows.observe(counts, *call_metrics()).write.parquet(path)
    rows = fold_pages(pages.sparkSession.read.schema(rows.schema).parquet(path), KEYS, ORDER)
    write_jdbc(
        rows.select(*CALL_SCHEMA.names),
        url,
        staging,
        staging_sql(target, staging),
        upsert_sql(target, staging),
        execute,
        properties,
    )
    return {**counts.get, **rejects.get, "pages": n_pages, "bad_pages": bad_pages}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
