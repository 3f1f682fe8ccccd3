"""A Spark data source over a paged service.

    register_paged(spark, spec, fetch)
    spark.read.format("paged").option("total", n).option("page_size", m).load()

Offset ranges are read in parallel on the executors. The output is the page bodies, which
Spark then parses like landed ones; with a schema given by ``.schema(...)`` it is the rows
themselves, and range filters on the source's time column are then sent with the request.
"""

from __future__ import annotations

import json
import math
import re
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import date

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import callharmony
from callharmony.sources.http import PageRequest, http_fetch, literal, name_in, page_request
from callharmony.sources.specs import SourceSpec

BODY_SCHEMA = "page_seq INT, body STRING"

Fetch = Callable[[PageRequest], str]

# Filters that narrow a request, with their sign in the services' query dialects.
SIGNS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class OffsetRange(InputPartition):
    """Pages ``first .. last``; with no last page, up to the one that ends the fetch."""

    first: int
    last: int | None


def body_rows(spec: SourceSpec, body: str) -> tuple[list[dict], bool]:
    """The rows of one body, and whether the service said that there are more. A reply without rows ends the job."""
    value = json.loads(body)
    parents, truncated = (spec.envelope.array_path or "").split("."), False
    for name in filter(None, parents):
        truncated = isinstance(value, dict) and bool(value.get("records_truncated"))
        value = value.get(name) if isinstance(value, dict) else None
    if not isinstance(value, list):
        raise ValueError(f"{spec.slug}: a reply without rows: {body[:200]}")
    rows = value
    if spec.envelope.row_field:
        rows = [row[spec.envelope.row_field] for row in rows]
    return rows, truncated


def joined(spec: SourceSpec, bodies: list[str]) -> str:
    """The last body with the rows of all, in order; numbers stay as they were written."""
    if len(bodies) == 1:
        return bodies[0]
    mark = secrets.token_hex(16)
    values = [json.loads(body, parse_int=lambda n: mark + n, parse_float=lambda n: mark + n) for body in bodies]
    rows, names = [], list(filter(None, (spec.envelope.array_path or "").split(".")))
    for value in values:
        found = value
        for name in names:
            found = found[name]
        rows += found
    found[:] = rows
    return re.sub(rf'"{mark}([^"]*)"', r"\1", json.dumps(values[-1], ensure_ascii=False))


class PagedReader(DataSourceReader):
    def __init__(self, spec: SourceSpec, fetch: Fetch, schema: StructType, options: dict[str, str], as_rows: bool):
        self.spec = replace(spec, page_size=int(options.get("page_size", spec.page_size or 0)))
        self.fetch = fetch
        self.schema = schema
        self.as_rows = as_rows
        self.total = int(options["total"]) if "total" in options else None
        self.pages_per_task = int(options.get("pages_per_task", 16))
        self.where = ""

    def partitions(self) -> list[OffsetRange]:
        """Ranges of whole pages, the last one open, so that rows added meanwhile are read too.

        A service that chooses its own page size gives the next offset only with each reply,
        so its pages are one range; with a page size in the spec it is asked for pages of that.
        """
        if self.total is None or not self.spec.page_size:
            return [OffsetRange(0, None)]
        pages = max(1, -(-self.total // self.spec.page_size))
        starts = range(0, pages, self.pages_per_task)
        return [
            OffsetRange(first, first + self.pages_per_task - 1 if first != starts[-1] else None) for first in starts
        ]

    def read(self, partition: OffsetRange):
        page = partition.first
        offset = page * self.spec.page_size
        while partition.last is None or page <= partition.last:
            body, rows, truncated = self._page(offset)
            if self.as_rows:
                yield self._batch(rows)
            else:
                yield (page, body)
            ends = not truncated and len(rows) < (self.spec.page_size or math.inf)
            # With a filter sent along there are fewer rows than planned for.
            if ends and (partition.last is None or self.where):
                return
            page += 1
            offset += self.spec.page_size or len(rows)

    def _page(self, offset: int) -> tuple[str, list[dict], bool]:
        """One page; of a service that grants fewer rows than asked and says that there are more, all its parts."""
        bodies, rows, size = [], [], self.spec.page_size
        while True:
            spec = replace(self.spec, page_size=size and size - len(rows))
            bodies.append(self.fetch(page_request(spec, offset + len(rows), self.where)))
            more, truncated = body_rows(self.spec, bodies[-1])
            rows += more
            if truncated and not more:
                raise ValueError(f"{spec.slug}: no rows at offset {offset + len(rows)}, and yet there are more")
            if not (size and truncated and len(rows) < size):
                return joined(self.spec, bodies), rows, truncated

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        lowered = [{name.lower(): value for name, value in row.items()} for row in rows]
        arrow = to_arrow_schema(self.schema)
        text = pa.types.is_string
        columns = [
            pa.array(
                [
                    v if v is None or isinstance(v, str) or not text(f.type) else json.dumps(v, ensure_ascii=False)
                    for v in (row.get(f.name.lower()) for row in lowered)
                ],
                type=f.type,
            )
            for f in arrow
        ]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)


class FilteredReader(PagedReader):
    """Rows with range filters on the time column sent along; Spark still applies every filter itself.

    Only bounds that are times are sent: text and numbers order or print differently at the services.
    Spark refuses a reader with filters where ``spark.sql.python.filterPushdown.enabled`` is off.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        time_columns = {name.lower(): name for name in self.spec.time.columns} if len(self.spec.time.columns) == 1 else {}
        bounds = []
        for each in filters:
            sign = SIGNS.get(type(each))
            name = sign and time_columns.get(".".join(each.attribute).lower())
            if name and isinstance(each.value, date) and self.spec.time.tz is None and not self.spec.time.epoch_ms:
                bounds.append(f"{name_in(self.spec, name)} {sign} {literal(self.spec, each.value)}")
            yield each
        self.where = " AND ".join(bounds)


def paged_source(
    spec: SourceSpec, fetch: Fetch = http_fetch, name: str = "paged", pushdown: bool = True
) -> type[DataSource]:
    """A data source class for one source, with the function that sends a request; ``pushdown`` sends filters along."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BODY_SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            as_rows = [name.lower() for name in schema.names] != ["page_seq", "body"]
            reader = FilteredReader if as_rows and pushdown else PagedReader
            return reader(spec, fetch, schema, dict(self.options), as_rows)

    return Paged


def register_paged(
    spark: SparkSession, spec: SourceSpec, fetch: Fetch = http_fetch, name: str = "paged"
) -> None:
    """Make the source readable as ``format(name)``.

    The package travels with the class, which is pickled here, so executors need no copy of it.
    Later functions are pickled as usual. Filters are sent along if the session's setting allows it now.
    """
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    cloudpickle.register_pickle_by_value(callharmony)
    try:
        spark.dataSource.register(paged_source(spec, fetch, name, pushdown))
    finally:
        cloudpickle.unregister_pickle_by_value(callharmony)
