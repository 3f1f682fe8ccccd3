"""The library's operators and jobs as queries over the given tables, each with its SQL twin.

The tables stand in for the cities' data: where a query needs response bodies, Spark builds
them from a whole table, one page per thousand ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from callharmony.functions import epoch_ms_to_ts, join_date_time, local_to_utc, text_to_ts
from callharmony.operators import (
    apply_range,
    call_metrics,
    conform,
    delete_matching,
    fold_pages,
    label,
    map_call_type,
    map_fields,
    page_audit,
    page_counts,
    upsert,
)
from callharmony.operators.crosswalk import crosswalk_of, load_crosswalk
from callharmony.plans.jobs import audit, fetch_pages, harmonize, read_rejected, run, run_all
from callharmony.schema import CALL_SCHEMA
from callharmony.session import workspace
from callharmony.sinks import CallTable, land_raw, land_raw_text
from callharmony.sources import (
    DATASTORE,
    FEATURES,
    ROW_ARRAY,
    SPECS,
    Envelope,
    SourceSpec,
    TimeRule,
    land_pages,
    observed_fields,
    parse_body,
    raw_rows,
    read_array_files,
    read_datastore_pages,
    read_feature_pages,
    read_page_table,
    read_row_array,
    read_row_lines,
    register_raw,
    register_raw_runs,
    replace_run,
    unwrap,
)
from callharmony.sources.paged import register_paged
from callharmony.streaming import run_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function, under its own name by default, with the SQL that gives the same rows."""

    def register(build: Query) -> Query:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain_times(build(spark, sf_dir))

        QUERIES[name or build.__name__] = call
        ORACLES[name or build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_times(df: DataFrame) -> DataFrame:
    """UTC times without a zone, as the SQL side has them."""
    times = {
        f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, TimestampType)
    }
    return df.withColumns(times) if times else df


# Canonical rows from the events table

EVENT_CODES = {"click": "SUSP", "view": "INFO", "purchase": "LARCENY", "error": "TROUBLE"}


def event_crosswalk(spark: SparkSession, dataset: str) -> DataFrame:
    return crosswalk_of(spark, [(dataset, text, code) for text, code in EVENT_CODES.items()])


def event_code_sql(column: str) -> str:
    whens = " ".join(f"WHEN '{text}' THEN '{code}'" for text, code in EVENT_CODES.items())
    return f"CASE {column} {whens} END"


def canonical_sql(source: str, **columns: str) -> str:
    """Select of the 14 columns; those not given are typed nulls."""
    types = {"string": "VARCHAR", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}
    listed = [
        f"CAST({columns.get(f.name, 'NULL')} AS {types[f.dataType.simpleString()]}) AS {f.name}"
        for f in CALL_SCHEMA
    ]
    return f"SELECT {', '.join(listed)} FROM {source}"


def canonical_events(spark: SparkSession, sf_dir: str, call_time: Column, dataset: str = "Events") -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", call_time.alias("call_time"), "event_type", "value")
    coded = map_call_type(label(rows, dataset), event_crosswalk(spark, dataset), "event_type")
    mapped = map_fields(
        coded,
        [
            ("dataset", "string", "dataset", "string"),
            ("EVENT_ID", "bigint", "call_id", "string"),
            ("call_time", "timestamp", "call_time", "timestamp"),
            ("event_type", "string", "call_type", "string"),
            ("common_call_type", "string", "common_call_type", "string"),
            ("no_such_field", "bigint", "alcohol", "boolean"),
        ],
    )
    return conform(mapped, CALL_SCHEMA)


def canonical_events_sql(call_time: str) -> str:
    return canonical_sql(
        "events",
        dataset="'Events'",
        call_id="event_id",
        call_time=call_time,
        call_type="event_type",
        common_call_type=event_code_sql("event_type"),
    )


NEW_YORK_SQL = "timezone('UTC', timezone('America/New_York', {}))"


@query(canonical_events_sql(NEW_YORK_SQL.format("ts")))
def canonical_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir, local_to_utc(F.col("ts").cast("string"), "America/New_York"))


@query(canonical_events_sql("date_trunc('milliseconds', ts)"))
def canonical_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir, epoch_ms_to_ts(F.unix_millis(F.col("ts").cast("timestamp"))))


@query(canonical_events_sql(NEW_YORK_SQL.format("date_trunc('second', ts)")))
def canonical_date_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = join_date_time(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))
    return canonical_events(spark, sf_dir, local_to_utc(parts, "America/New_York"))


@query(canonical_events_sql("ts"))
def canonical_text_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir, text_to_ts(F.col("ts").cast("string")))


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS call_id, CAST(quality AS BOOLEAN) AS alcohol, "
    "CAST(toxic AS BOOLEAN) AS drug, CAST(NULL AS BOOLEAN) AS mental_health FROM labels"
)
def canonical_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_fields(
        table(spark, sf_dir, "labels"),
        [
            ("doc_id", "bigint", "call_id", "string"),
            ("quality", "bigint", "alcohol", "boolean"),
            ("toxic", "bigint", "drug", "boolean"),
            ("mental_health", "bigint", "mental_health", "boolean"),
        ],
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_body(table(spark, sf_dir, "events"), "k BIGINT", body="props")
    return parsed.select("event_id", F.col("parsed.k").alias("k"))


# Response bodies built from a table, and the scans that read them

EVENT_FIELDS = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
EVENT_ROWS_SQL = (
    "SELECT CAST(event_id // 1000 AS INTEGER) AS page_seq, event_id, user_id, event_type, value, props FROM events"
)


PAGE_ROWS = 1000


def page_bodies(rows: DataFrame, envelope: Envelope, page: Column, fields: list[Column]) -> DataFrame:
    """One body per page of ``PAGE_ROWS`` ids, in the given envelope, ended as the source's services end a fetch.

    The last page says that nothing was cut off, or is short; where it is full, an empty one follows.
    """
    row = F.struct(*fields)
    rows_of_page = F.collect_list(F.struct(row.alias(envelope.row_field)) if envelope.row_field else row)
    paged = rows.groupBy(page.cast("int").alias("page_seq")).agg(rows_of_page.alias("rows"), F.count(F.lit(1)).alias("n"))
    final = paged.agg(F.max(F.struct("page_seq", "n")).alias("final"))
    empty = F.array().cast(paged.schema["rows"].dataType)
    after = final.where(F.col("final.n") >= PAGE_ROWS).select((F.col("final.page_seq") + 1).alias("page_seq"), empty.alias("rows"), F.lit(0).cast("bigint").alias("n"))
    paged = paged.unionByName(after).join(F.broadcast(final))  # one row
    if envelope.array_path is None:
        body = F.col("rows")
    else:
        *parents, last = envelope.array_path.split(".")
        inside = [F.col("rows").alias(last)]
        if envelope.truncated_path:
            more = F.col("page_seq") < F.col("final.page_seq") + (F.col("final.n") >= PAGE_ROWS).cast("int")
            inside.append(more.alias(envelope.truncated_path.split(".")[-1]))
        body = F.struct(*inside)
        for parent in reversed(parents):
            body = F.struct(body.alias(parent))
    return paged.select("page_seq", F.to_json(body).alias("body"))


def event_bodies(spark: SparkSession, sf_dir: str, envelope: Envelope) -> DataFrame:
    names = [part.split()[0] for part in EVENT_FIELDS.split(", ")]
    return page_bodies(
        table(spark, sf_dir, "events"), envelope, F.expr("event_id div 1000"), [F.col(n) for n in names]
    )


def page_files(bodies: DataFrame, path: str) -> str:
    """Each body as a file of its own, below a folder that names its page."""
    bodies.repartition("page_seq").write.partitionBy("page_seq").text(path)
    return path


@query(EVENT_ROWS_SQL)
def feature_pages_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = page_files(event_bodies(spark, sf_dir, FEATURES), workspace(spark, "features"))
    return read_feature_pages(spark, path, EVENT_FIELDS)


@query(EVENT_ROWS_SQL)
def datastore_pages_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = event_bodies(spark, sf_dir, SPECS["arizona-phoenix"].envelope)
    return read_datastore_pages(spark, page_files(bodies, workspace(spark, "datastore")), EVENT_FIELDS)


@query(EVENT_ROWS_SQL)
def row_array_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = event_bodies(spark, sf_dir, SPECS["florida-gainesville"].envelope)
    return read_row_array(spark, page_files(bodies, workspace(spark, "rowarray")), EVENT_FIELDS)


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def row_array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the one array, without line breaks, that a service sends for them."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    ends = rows.agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    text = F.concat(
        F.when(F.col("event_id") == F.col("first"), "[").otherwise(""),
        F.to_json(F.struct(*rows.columns)),
        F.when(F.col("event_id") == F.col("last"), "]").otherwise(""),
    )
    path = workspace(spark, "array")
    # One file has one writer, which takes the sorted rows as they come.
    rows.join(F.broadcast(ends)).orderBy("event_id").select(text).coalesce(1).write.option("lineSep", ",").text(path)
    parsed = parse_body(read_array_files(spark, path), ROW_ARRAY.schema(f"struct<{EVENT_FIELDS}>"))
    return unwrap(parsed, ROW_ARRAY.array_path)


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def row_lines_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    line = F.to_json(F.struct("*"))
    arrays = rows.groupBy(F.expr("event_id div 1000").alias("page_seq")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(line), "\n,"), F.lit("\n]")).alias("body")
    )
    path = workspace(spark, "rowlines")
    arrays.select("body").write.text(path)
    return read_row_lines(spark, path, EVENT_FIELDS)


@query(EVENT_ROWS_SQL)
def page_table_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "pagetable")
    bodies = event_bodies(spark, sf_dir, FEATURES)
    land_pages(bodies.withColumns({"dataset": F.lit("events"), "run_id": F.lit("r1")}), path)
    parsed = parse_body(read_page_table(spark, path), FEATURES.schema(f"struct<{EVENT_FIELDS}>"))
    return unwrap(parsed, FEATURES.array_path, FEATURES.row_field, keep=["page_seq"])


EVENTS_SPEC = SourceSpec(
    slug="events",
    label="Events",
    envelope=FEATURES,
    time=TimeRule(("ts",)),
    texts={"call_id": "event_id", "call_type": "event_type"},
    page_size=PAGE_ROWS,
)


def paged_events(spark: SparkSession, sf_dir: str, envelope: Envelope, none: str) -> DataFrame:
    """Bodies of all events, asked for page by page, several pages to a task; ``none`` is a reply without rows."""
    root = page_files(event_bodies(spark, sf_dir, envelope), workspace(spark, "service"))

    def fetch(request) -> str:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        folder = fs.FileSelector(f"{path}/page_seq={request.offset // request.limit}", allow_not_found=True)
        files = [f.path for f in system.get_file_info(folder) if f.base_name.startswith("part-")]
        if not files:
            return none
        with system.open_input_stream(files[0]) as stream:
            return stream.read().decode("utf-8")

    register_paged(spark, replace(EVENTS_SPEC, envelope=envelope), fetch, name=f"paged_events_{envelope.name}")
    total = table(spark, sf_dir, "events").count()
    return spark.read.format(f"paged_events_{envelope.name}").options(total=total, pages_per_task=2).load()


@query(EVENT_ROWS_SQL)
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = paged_events(spark, sf_dir, FEATURES, '{"features": []}')
    parsed = parse_body(bodies, FEATURES.schema(f"struct<{EVENT_FIELDS}>"))
    return unwrap(parsed, FEATURES.array_path, FEATURES.row_field, keep=["page_seq"])


@query(EVENT_ROWS_SQL)
def paged_datastore(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = paged_events(spark, sf_dir, DATASTORE, '{"result": {"records": []}}')
    return unwrap(parse_body(bodies, DATASTORE.schema(f"struct<{EVENT_FIELDS}>")), DATASTORE.array_path, keep=["page_seq"])


@query(EVENT_ROWS_SQL)
def paged_row_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = paged_events(spark, sf_dir, ROW_ARRAY, "[]")
    return unwrap(parse_body(bodies, ROW_ARRAY.schema(f"struct<{EVENT_FIELDS}>")), ROW_ARRAY.array_path, keep=["page_seq"])


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def paged_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, fetched by ranges of their ids and landed; the service grants at most 300 rows at a time."""
    root = page_files(event_bodies(spark, sf_dir, ROW_ARRAY), workspace(spark, "service"))
    bounds = table(spark, sf_dir, "events").agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()

    def fetch(request) -> str:
        import json
        import re

        from pyarrow import fs

        if "returnCountOnly" in request.params:
            return json.dumps({"count": bounds[2]})
        system, path = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        limits = {sign: int(value) for sign, value in re.findall(r"event_id (>|<=) (-?\d+)", request.params["where"])}
        low, high = limits.get(">", bounds[0] - 1), min(limits.get("<=", bounds[1]), bounds[1])
        low = high - 1 if "DESC" in request.params["orderByFields"] else low
        found = []
        while not found and low < high:
            page = (low + 1) // 1000
            folder = fs.FileSelector(f"{path}/page_seq={page}", allow_not_found=True)
            for file in system.get_file_info(folder):
                if file.base_name.startswith("part-"):
                    with system.open_input_stream(file.path) as stream:
                        found += [row for row in json.loads(stream.read()) if low < row["event_id"] <= high]
            low = max(low, page * 1000 + 999)
        found = sorted(found, key=lambda row: row["event_id"])[: min(request.limit, 300)]
        return json.dumps({"features": [{"attributes": row} for row in found]})

    spec = replace(EVENTS_SPEC, key="event_id")
    pages = fetch_pages(spark, spec, workspace(spark, "landing"), "r1", fetch, pages_per_task=2)
    return unwrap(parse_body(pages, FEATURES.schema(f"struct<{EVENT_FIELDS}>")), FEATURES.array_path, FEATURES.row_field)


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(value AS DOUBLE) AS value FROM events WHERE event_type <> 'error'")
def paged_rows_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows straight from the service, filtered by Spark."""
    paged_events(spark, sf_dir, FEATURES, '{"features": []}')
    total = table(spark, sf_dir, "events").count()
    reader = spark.read.format("paged_events_features").options(total=total, pages_per_task=2)
    rows = reader.schema("event_id STRING, event_type STRING, value STRING").load()
    return rows.where("event_type <> 'error'").select("event_id", F.col("value").cast("double").alias("value"))


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS field, CAST(count({name}) AS BIGINT) AS n FROM events HAVING count({name}) > 0"
        for name in ("event_id", "user_id", "event_type", "value", "props")
    )
)
def observed_field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_fields(event_bodies(spark, sf_dir, FEATURES), FEATURES)


# Range predicates, moved into the years of the orders table


def orders_in(spark: SparkSession, sf_dir: str, low=None, high=None, half_open: bool = False) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return apply_range(orders, "o_orderdate", low, high, half_open)


def orders_sql(condition: str) -> str:
    return f"SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE {condition}"


@query(orders_sql("o_orderdate BETWEEN DATE '1996-12-31' AND DATE '1998-01-01'"))
def range_filter_w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_in(spark, sf_dir, F.lit("1996-12-31").cast("date"), F.lit("1998-01-01").cast("date"))


@query(orders_sql("o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 11:59:59'"))
def range_filter_w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_in(spark, sf_dir, "1997-01-01T00:00:00", "1997-12-31T11:59:59")


@query(orders_sql("o_orderdate >= DATE '1997-01-01' AND o_orderdate <= DATE '1997-12-31'"))
def range_filter_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_in(spark, sf_dir, F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))


@query(orders_sql("1 = 1"))
def range_filter_w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_in(spark, sf_dir)


@query(
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' "
    "AND ts < TIMESTAMP '2024-01-20 00:00:00'"
)
def range_filter_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return apply_range(events, "ts", "2024-01-05T00:00:00", "2024-01-20T00:00:00", half_open=True)


# Joins and upserts

PRIORITY_CODES = {"1-URGENT": "911H", "2-HIGH": "ASSIST", "3-MEDIUM": "INFO", "5-LOW": "ADMIN"}


@query(
    "SELECT o.o_orderkey, o.o_orderpriority, x.common_call_type FROM orders o LEFT JOIN (VALUES {}) "
    "AS x(call_type, common_call_type) ON o.o_orderpriority = x.call_type".format(
        ", ".join(f"('{k}', '{v}')" for k, v in PRIORITY_CODES.items())
    )
)
def crosswalk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    codes = [("Orders", text, code) for text, code in PRIORITY_CODES.items()]
    crosswalk = crosswalk_of(spark, codes)
    return map_call_type(label(orders, "Orders"), crosswalk, "o_orderpriority").drop("dataset")


@query(
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders o "
    "WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"
)
def upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return delete_matching(orders, keys, ["o_orderkey"])


def order_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a target; those of low priority have lost their key."""
    return table(spark, sf_dir, "orders").select(
        F.lit("Orders").alias("dataset"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey").cast("string")).alias("call_id"),
        F.col("o_orderstatus").alias("call_type"),
    )


def order_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their line items as a batch: several rows per key, and a third of all rows without one."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("Orders").alias("dataset"),
        F.when(F.col("l_returnflag") != "A", F.col("l_orderkey").cast("string")).alias("call_id"),
        F.col("l_linestatus").alias("call_type"),
    )


ORDER_UPSERT_SQL = """
WITH target AS (
    SELECT 'Orders' AS dataset, o_orderstatus AS call_type,
           CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderkey AS VARCHAR) END AS call_id FROM orders
), batch AS (
    SELECT 'Orders' AS dataset, l_linestatus AS call_type,
           CASE WHEN l_returnflag <> 'A' THEN CAST(l_orderkey AS VARCHAR) END AS call_id FROM lineitem
), result AS (
    SELECT dataset, call_id, call_type FROM target t
    WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.call_id = t.call_id AND b.dataset = t.dataset)
    UNION ALL SELECT dataset, call_id, call_type FROM batch
)
"""


@query(ORDER_UPSERT_SQL + "SELECT dataset, call_id, call_type FROM result")
def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(order_target(spark, sf_dir), order_batch(spark, sf_dir))


@query(ORDER_UPSERT_SQL + canonical_sql("result", dataset="dataset", call_id="call_id", call_type="call_type"))
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = CallTable(spark, workspace(spark, "upsert"))
    calls.upsert(conform(order_target(spark, sf_dir), CALL_SCHEMA))
    calls.upsert(conform(order_batch(spark, sf_dir), CALL_SCHEMA))
    return calls.read()


@query(
    """
WITH paged AS (
    SELECT event_id, event_id // 1000 AS page_seq, value,
           CASE WHEN event_type <> 'error' THEN user_id END AS user_id FROM events
), ranked AS (SELECT *, max(page_seq) OVER (PARTITION BY user_id) AS last FROM paged)
SELECT event_id, page_seq, user_id, value FROM ranked WHERE user_id IS NULL OR page_seq = last
"""
)
def upsert_page_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("event_id div 1000").alias("page_seq"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        "value",
    )
    return fold_pages(paged, ["user_id"], "page_seq")


# Counts and audits


@query(
    "SELECT dataset, page_seq, n, CAST(sum(n) OVER (PARTITION BY dataset ORDER BY page_seq) AS BIGINT) AS running "
    "FROM (SELECT event_type AS dataset, event_id // 1000 AS page_seq, count(*) AS n FROM events GROUP BY ALL)",
    name="page_counts",
)
def counted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset"), F.expr("event_id div 1000").alias("page_seq")
    )
    return page_counts(rows)


AUDITED = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}
AUDIT_SQL = """
WITH counts AS ({}), seen AS (
    SELECT *, CAST(sum(n) OVER w AS BIGINT) AS running, lead(page_seq) OVER w AS next_seq,
           min(page_seq) OVER (PARTITION BY dataset) AS first_seq
    FROM counts WINDOW w AS (PARTITION BY dataset ORDER BY page_seq)
)
SELECT dataset, page_seq, n, running, running - n AS "offset", next_seq IS NULL AS is_last,
       n < 1000 AS is_short, TRUE AS has_rows,
       (page_seq > first_seq OR page_seq = 0) AND coalesce(next_seq = page_seq + 1, TRUE)
           AND (next_seq IS NULL) = (n < 1000) AS complete
FROM seen
""".format(
    " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, {key} // 1000 AS page_seq, count(*) AS n FROM {name} GROUP BY ALL"
        for name, key in AUDITED.items()
    )
)


@query(AUDIT_SQL, name="page_audit")
def audited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = None
    for name, key in AUDITED.items():
        rows = table(spark, sf_dir, name).select(
            F.lit(name).alias("dataset"), F.expr(f"{key} div 1000").alias("page_seq")
        )
        counts = rows if counts is None else counts.unionByName(rows)
    counts = counts.groupBy("dataset", "page_seq").agg(F.count(F.lit(1)).alias("n"))
    return page_audit(counts, page_size=1000)


@query(
    "SELECT 'events' AS dataset, 'r1' AS run_id, page_seq, n, CAST(sum(n) OVER w AS BIGINT) AS running, "
    "CAST(sum(n) OVER w AS BIGINT) - n AS \"offset\", lead(page_seq) OVER w IS NULL AS is_last, "
    "n < 1000 AS is_short, TRUE AS has_rows, (lead(page_seq) OVER w IS NULL) = (n < 1000) AS complete "
    "FROM (SELECT CAST(event_id // 1000 AS INTEGER) AS page_seq, count(*) AS n FROM events GROUP BY ALL "
    "UNION ALL SELECT CAST(max(event_id) // 1000 AS INTEGER) + 1, 0 FROM events "
    "HAVING max(event_id) % 1000 = 999) "
    "WINDOW w AS (ORDER BY page_seq)"
)
def body_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = event_bodies(spark, sf_dir, FEATURES)
    return audit(EVENTS_SPEC, bodies.withColumns({"dataset": F.lit("events"), "run_id": F.lit("r1")}))


# Landing


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def raw_landing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string"))
    path = land_raw(rows, workspace(spark, "lake"), "events", "r1")
    register_raw(spark, "callharmony_raw_events", path, f"{EVENT_FIELDS}, ts STRING")
    raw = spark.table("callharmony_raw_events")
    return raw.withColumn("ts", text_to_ts(F.col("ts"))).select(*rows.columns)


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def raw_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_rows(event_bodies(spark, sf_dir, FEATURES), FEATURES)
    path = land_raw_text(rows, workspace(spark, "lake"), "events", "r1")
    return spark.read.schema(EVENT_FIELDS).json(path)


@query(
    "SELECT event_id, user_id, event_type, value, props, CASE WHEN event_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS run_id "
    "FROM events"
)
def raw_runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two landed runs as one table of the catalog, split by run."""
    rows, lake = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"), workspace(spark, "lake")
    for rest, run_id in enumerate(("r1", "r2")):
        land_raw(rows.where(F.col("event_id") % 2 == rest), lake, "events", run_id)
    register_raw_runs(spark, "callharmony_raw_runs", lake, "events", EVENT_FIELDS)
    return spark.table("callharmony_raw_runs").select(*rows.columns, "run_id")


# The jobs, on pages in each source's own shape


@dataclass(frozen=True)
class StandIn:
    """How events become a source's rows: field expressions, and the same values in SQL.

    Times move back by 739 days, across the end of the sources' ranges. Paged sources get
    few ids, so that later pages supersede earlier ones, and no id for errors.
    """

    call_types: dict[str, str]
    call_type: str
    call_id: str
    call_id_sql: str
    time_fields: dict[str, str]
    time_sql: str
    where_sql: str = "TRUE"
    fields: dict[str, str] = None
    extra_sql: dict[str, str] = None


MOVED = "ts - INTERVAL 739 DAYS"
MOVED_SQL = "ts - INTERVAL 739 DAY"
USER_ID = "CASE WHEN event_type <> 'error' THEN user_id END"
FLAGS = {
    "alcohol_related": "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 END",
    "dv_related": "user_id",
    "drug_related": "CASE event_type WHEN 'purchase' THEN 2 END",
}
FLAGS_SQL = {
    "alcohol": "CASE event_type WHEN 'view' THEN FALSE WHEN 'click' THEN TRUE END",
    "domestic_violence": "user_id <> 0",
    "drug": "CASE event_type WHEN 'purchase' THEN TRUE END",
}
LOCAL_SQL = "timezone('UTC', timezone('{}', {}))"


# Of every fifty rows of a source with a time range, one has no time and one has a time that cannot be read.
def spoilt(time: str) -> str:
    return f"CASE event_id % 50 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE {time} END"


def spoilt_sql(time: str) -> str:
    return f"CASE WHEN event_id % 50 > 1 THEN {time} END"


def spoilt_where(condition: str) -> str:
    return f"(event_id % 50 <= 1 OR {condition})"


STAND_INS = {
    "arizona-phoenix": StandIn(
        call_types={
            "view": "FIGHT",
            "click": "SUSPICIOUS PERSON",
            "purchase": "TRESPASSING",
            "signup": "NOT LISTED",
            "error": "DOMESTIC VIOLENCE",
        },
        call_type="FINAL_CALL_TYPE",
        call_id="INCIDENT_NUM",
        call_id_sql=USER_ID,
        time_fields={"CALL_RECEIVED": spoilt(f"CAST({MOVED} AS STRING)")},
        time_sql=spoilt_sql(LOCAL_SQL.format("America/Phoenix", MOVED_SQL)),
        where_sql=spoilt_where(f"{MOVED_SQL} BETWEEN DATE '2020-12-31' AND DATE '2022-01-01'"),
        fields={"DISPOSITION": "upper(event_type)", "priority": "length(event_type)", **FLAGS},
        extra_sql={"disposition": "upper(event_type)", "priority": "length(event_type)", **FLAGS_SQL},
    ),
    "florida-gainesville": StandIn(
        call_types={
            "view": "Affray",
            "click": "Suicide",
            "purchase": "suicide",
            "signup": "Theft Grand - Value 300 to 4",
            "error": "Noise Complaint",
        },
        call_type="narrative",
        call_id="id",
        call_id_sql=USER_ID,
        time_fields={"report_date": spoilt(f"date_format({MOVED}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")")},
        time_sql=spoilt_sql(LOCAL_SQL.format("America/New_York", MOVED_SQL)),
        where_sql=spoilt_where(
            f"{MOVED_SQL} BETWEEN TIMESTAMP '2021-01-01 00:00:00' AND TIMESTAMP '2021-12-31 11:59:59'"
        ),
        fields={"priority": "length(event_type)", **FLAGS},
        extra_sql={"priority": "length(event_type)", **FLAGS_SQL},
    ),
    "louisiana-new-orleans": StandIn(
        call_types={
            "view": "SIMPLE ROBBERY, PROPERTY SNATCHING",
            "click": "SUICIDE",
            "purchase": "NOISE COMPLAINT",
            "signup": "NOT LISTED",
            "error": "TRAFFIC STOP",
        },
        call_type="initialtypetext",
        call_id="nopd_item",
        call_id_sql=USER_ID,
        time_fields={"timecreate": f"CAST({MOVED} AS STRING)"},
        time_sql=LOCAL_SQL.format("America/Chicago", MOVED_SQL),
        fields={"dispositiontext": "upper(event_type)", "priority": "length(event_type)", **FLAGS},
        extra_sql={"disposition": "upper(event_type)", "priority": "length(event_type)", **FLAGS_SQL},
    ),
    "maryland-baltimore": StandIn(
        call_types={t: t for t in ("view", "click", "purchase", "signup", "error")},
        call_type="description",
        call_id="callNumber",
        call_id_sql=USER_ID,
        time_fields={"callDateTime": spoilt(f"CAST(unix_millis(CAST({MOVED} AS TIMESTAMP)) AS STRING)")},
        time_sql=spoilt_sql(f"date_trunc('milliseconds', {MOVED_SQL})"),
        where_sql=spoilt_where(
            f"(date_trunc('milliseconds', {MOVED_SQL}) >= DATE '2021-01-01' "
            f"AND date_trunc('milliseconds', {MOVED_SQL}) <= DATE '2021-12-31')"
        ),
        fields={"PRIORITY": "length(event_type)"},
        extra_sql={"priority": "length(event_type)"},
    ),
    "massachusetts-worcester": StandIn(
        call_types={
            "view": "BEC - Commercial B&E",
            "click": "LAO - Larceny Over $250",
            "purchase": "SUS - Suspicous Person",
            "signup": "SUS - Suspicious Person",
            "error": "UNK - Unknown Problem",
        },
        call_type="Incident_Type",
        call_id="Incident_Number",
        call_id_sql=USER_ID,
        time_fields={
            "Date_Logged": f"date_format({MOVED}, 'yyyy-MM-dd')",
            "Time_Logged": f"date_format({MOVED}, 'HH:mm:ss')",
        },
        time_sql=LOCAL_SQL.format("America/New_York", f"date_trunc('second', {MOVED_SQL})"),
        fields={},
        extra_sql={},
    ),
    "vermont-burlington": StandIn(
        call_types={
            "view": "911 Hangup",
            "click": "TRO/FRO Violation",
            "purchase": "Welfare Check",
            "signup": "NOT LISTED",
            "error": "Noise",
        },
        call_type="call_type",
        call_id="incident_number",
        call_id_sql=USER_ID,
        time_fields={"call_time": f"CAST({MOVED} AS STRING)"},
        time_sql=MOVED_SQL,
        fields={"priority": "length(event_type)", **FLAGS, "mental_health": "length(event_type) - 4"},
        extra_sql={"priority": "length(event_type)", **FLAGS_SQL, "mental_health": "length(event_type) <> 4"},
    ),
}

# The codes the chosen call types have in the packaged dictionaries.
EXPECTED_CODES = {
    "arizona-phoenix": {
        "view": "FIGHT", "click": "PERSUSP", "purchase": "TRESPASS", "error": "DVA",
    },
    "florida-gainesville": {
        "view": "FIGHT", "click": "SUICIDE", "signup": "999", "error": "NOISE",
    },
    "louisiana-new-orleans": {
        "view": "ROBBERY", "click": "SUICTHRT", "purchase": "NEGLECT", "error": "TSTOP",
    },
    "maryland-baltimore": {},
    "massachusetts-worcester": {
        "view": "BURGLARY", "click": "LARCENY", "purchase": "PERSUSP", "error": "TROUBLE",
    },
    "vermont-burlington": {
        "view": "911H", "click": "ORDERV", "purchase": "WELFARE", "error": "NEGLECT",
    },
}


def case(values: dict[str, str], column: str = "event_type") -> str:
    if not values:
        return "NULL"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def source_pages(spark: SparkSession, sf_dir: str, slug: str, events: DataFrame | None = None) -> DataFrame:
    """Landed pages of one source, with every event in them."""
    events = table(spark, sf_dir, "events") if events is None else events
    stand_in, spec = STAND_INS[slug], SPECS[slug]
    expressions = {
        stand_in.call_id: stand_in.call_id_sql,
        stand_in.call_type: case(stand_in.call_types),
        **stand_in.time_fields,
        **stand_in.fields,
        "other_field": "value",
    }
    fields = [F.expr(e).alias(name) for name, e in expressions.items()]
    bodies = page_bodies(events, spec.envelope, F.expr("event_id div 1000"), fields)
    return bodies.select(F.lit(slug).alias("dataset"), F.lit("r1").alias("run_id"), "page_seq", "body")


def source_sql(slug: str) -> str:
    """The canonical rows the job must give for ``source_pages``, as a sub-select."""
    stand_in, spec = STAND_INS[slug], SPECS[slug]
    last = "page_seq = max(page_seq) OVER (PARTITION BY id)" if spec.paged else "TRUE"
    rows = (
        f"(SELECT * FROM (SELECT *, id IS NULL OR {last} AS stays FROM "
        f"(SELECT *, {stand_in.call_id_sql} AS id, event_id // 1000 AS page_seq FROM events "
        f"WHERE {stand_in.where_sql})) WHERE stays)"
    )
    return canonical_sql(
        rows,
        dataset=f"'{spec.label}'",
        call_id="id",
        call_time=stand_in.time_sql,
        call_type=case(stand_in.call_types),
        common_call_type=case(EXPECTED_CODES[slug]),
        **stand_in.extra_sql,
    )


def as_paged(slug: str) -> SourceSpec:
    """The source as its stand-in is paged."""
    return replace(SPECS[slug], page_size=PAGE_ROWS)


def job(slug: str) -> None:
    """Register the whole job of a source: raw rows landed, pages folded, calls upserted."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = workspace(spark, slug)
        calls = CallTable(spark, f"{root}/calls")
        land_pages(source_pages(spark, sf_dir, slug), f"{root}/pages")
        pages = read_page_table(spark, f"{root}/pages")
        run(as_paged(slug), pages, load_crosswalk(spark), calls, lake=f"{root}/lake", run_id="r1")
        return calls.read()

    query(source_sql(slug), name="job_" + slug.replace("-", "_"))(build)


for _slug in SPECS:
    job(_slug)


@query(
    f"SELECT 'Phoenix, AZ' AS dataset, CAST({USER_ID} AS VARCHAR) AS call_id, event_id // 1000 AS page_seq, "
    "CASE WHEN event_id % 50 = 1 THEN 'unreadable_time' ELSE 'out_of_range' END AS reasons, "
    "event_id % 50 <> 1 AS refused, upper(event_type) AS sent_disposition FROM events "
    f"WHERE event_id % 50 = 1 OR NOT {STAND_INS['arizona-phoenix'].where_sql}"
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run had against its rows, kept beside the table."""
    root, slug = workspace(spark, "rejected"), "arizona-phoenix"
    calls = CallTable(spark, f"{root}/calls")
    run(as_paged(slug), source_pages(spark, sf_dir, slug), load_crosswalk(spark), calls, run_id="r1", rejected=f"{root}/rejected")
    return read_rejected(spark, f"{root}/rejected", "r1").select(
        "dataset",
        "call_id",
        F.col("page_seq").cast("bigint").alias("page_seq"),
        F.array_join("reasons", ",").alias("reasons"),
        "refused",
        F.get_json_object("sent", "$.DISPOSITION").alias("sent_disposition"),
    )


@query(
    "SELECT dataset, count(*) AS n, count(call_id) AS with_id, count(common_call_type) AS with_code FROM ("
    + " UNION ALL ".join(source_sql(slug) for slug in SPECS)
    + ") GROUP BY dataset"
)
def all_sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = CallTable(spark, workspace(spark, "all"))
    pages = {as_paged(slug): source_pages(spark, sf_dir, slug) for slug in SPECS}
    run_all(pages, load_crosswalk(spark), calls)
    return calls.read().groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("call_id").alias("with_id"),
        F.count("common_call_type").alias("with_code"),
    )


@query(source_sql("vermont-burlington"))
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace(spark, "stream")
    pages = source_pages(spark, sf_dir, "vermont-burlington").select("page_seq", "body")
    landing = page_files(pages, f"{root}/run_id=r1")
    calls = CallTable(spark, f"{root}/calls")
    spec = SPECS["vermont-burlington"]
    run_stream(spec, landing, load_crosswalk(spark), calls, f"{root}/checkpoint", files_per_batch=64)
    return calls.read()


@query(source_sql("arizona-phoenix"))
def refetch_same_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is landed twice counts once."""
    root, slug = workspace(spark, "refetch"), "arizona-phoenix"
    calls = CallTable(spark, f"{root}/calls")
    for _ in range(2):
        replace_run(source_pages(spark, sf_dir, slug), f"{root}/pages", slug, "r1")
    run(as_paged(slug), read_page_table(spark, f"{root}/pages"), load_crosswalk(spark), calls)
    return calls.read()


@query(source_sql("louisiana-new-orleans"))
def row_array_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a source that replies in one batch, the last run's rows of a key stand."""
    root, slug = workspace(spark, "tworuns"), "louisiana-new-orleans"
    calls = CallTable(spark, f"{root}/calls")
    pages = source_pages(spark, sf_dir, slug)
    # Rows without a key pile up, so the earlier run has none of them; that leaves its pages short.
    keyed = table(spark, sf_dir, "events").where("event_type <> 'error'").withColumn("event_type", F.lit("view"))
    earlier = source_pages(spark, sf_dir, slug, keyed).withColumn("run_id", F.lit("r0"))
    both = pages.unionByName(earlier)
    run(as_paged(slug), both, load_crosswalk(spark), calls, allow_incomplete=True)
    return calls.read()


@query(
    "SELECT count(*) AS records, count(*) FILTER (event_type = 'error') AS null_keys, "
    "count(*) FILTER (event_type = 'signup') AS unmapped FROM events"
)
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SPECS["louisiana-new-orleans"]
    calls = harmonize(spec, source_pages(spark, sf_dir, spec.slug), load_crosswalk(spark))
    return calls.agg(*call_metrics())


@query(
    "SELECT event_type AS call_type, CAST(NULL AS BIGINT) AS priority, CAST(event_id AS VARCHAR) AS call_id "
    "FROM events"
)
def fields_in_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return map_fields(
        events,
        [
            ("EVENT_TYPE", "string", "call_type", "string"),
            ("no_such_field", "string", "priority", "bigint"),
            ("Event_Id", "bigint", "call_id", "string"),
        ],
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["canonical_local_time"](spark, sf_dir)
