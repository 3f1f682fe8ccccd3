"""Response bodies to rows: the three envelopes the sources use.

A body is parsed once, against a schema that names only the wanted fields, so every other
field is skipped by the JSON parser. A body without the expected row array gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

PAGE_COLUMNS = ("dataset", "run_id", "page_seq")


@dataclass(frozen=True)
class Envelope:
    """Where the row array sits in a body, and the struct around each row, if any."""

    name: str
    array_path: str | None = None
    row_field: str | None = None
    truncated_path: str | None = None

    def schema(self, row_type: str) -> str:
        """DDL of a whole body whose rows have the type ``row_type``."""
        element = f"struct<`{self.row_field}`: {row_type}>" if self.row_field else row_type
        ddl = f"array<{element}>"
        if self.array_path is None:
            return ddl
        *parents, last = self.array_path.split(".")
        inside = f"`{last}`: {ddl}"
        if self.truncated_path:
            inside += f", `{self.truncated_path.split('.')[-1]}`: boolean"
        for parent in reversed(parents):
            inside = f"`{parent}`: struct<{inside}>"
        return f"struct<{inside}>"

    def text(self, body: Column) -> Column:
        """The body, or null if it is one object where an array is due; Spark would take it for a row."""
        if self.array_path is not None:
            return body
        return F.when(F.ltrim(body, F.lit(" \t\r\n")).startswith("["), body)

    def parse(self, row_type: str) -> Column:
        return F.from_json(self.text(F.col("body")), self.schema(row_type))

    def rows(self, parsed: Column) -> Column:
        return at_path(parsed, self.array_path)

    def row(self, element: Column) -> Column:
        return element[self.row_field] if self.row_field else element


# The envelopes as the services send them.
FEATURES = Envelope("features", array_path="features", row_field="attributes")
DATASTORE = Envelope(
    "datastore", array_path="result.records", truncated_path="result.records_truncated"
)
ROW_ARRAY = Envelope("row_array")


def at_path(value: Column, path: str | None) -> Column:
    """The field at a dotted path below ``value``."""
    for name in path.split(".") if path else ():
        value = value[name]
    return value


def parse_body(
    df: DataFrame,
    schema: str | DataType,
    mode: str = "PERMISSIVE",
    body: str = "body",
    into: str = "parsed",
) -> DataFrame:
    """Parse a JSON text column against a schema, null where it does not fit."""
    return df.withColumn(into, F.from_json(F.col(body), schema, {"mode": mode}))


def unwrap(
    df: DataFrame,
    array_path: str | None,
    struct_field: str | None = None,
    parsed: str = "parsed",
    keep: Iterable[str] = (),
) -> DataFrame:
    """One row per array element, its fields as columns; an empty or missing array gives none."""
    element = F.explode(at_path(F.col(parsed), array_path)).alias("_row")
    fields = f"_row.{struct_field}.*" if struct_field else "_row.*"
    return df.select(*keep, element).select(*keep, fields)


def parse_rows(
    pages: DataFrame,
    envelope: Envelope,
    fields: Iterable[str],
    aliases: dict[str, Iterable[str]] | None = None,
    keep: Iterable[str] = PAGE_COLUMNS,
) -> DataFrame:
    """The named fields of every row as text, with the page they came from.

    Text is the one type that holds whatever a page sends: an id may be a number on one
    page and a string on the next. Names match in any letter case, row by row; ``aliases``
    are further spellings for the quick parse.
    """
    fields = list(fields)
    sent = [(name, spelling) for name in fields for spelling in (name, *(aliases or {}).get(name, ()))]
    # Spark resolves names in any case, so spellings of one name are told apart by position.
    by_position = "struct<{}>".format(", ".join(f"f{i}: string" for i in range(len(sent))))
    positions = {name: [i for i, (owner, _) in enumerate(sent) if owner == name] for name in fields}

    exact = envelope.parse("struct<{}>".format(", ".join(f"`{spelling}`: string" for _, spelling in sent)))
    element = f"struct<row: {by_position}>" if envelope.row_field else by_position
    parsed = pages.select(*keep, "body", envelope.rows(exact).cast(f"array<{element}>").alias("_rows"))
    row = (lambda e: e["row"]) if envelope.row_field else (lambda e: e)

    def value(r: Column, name: str) -> Column:
        return F.coalesce(*[r[f"f{i}"] for i in positions[name]])

    def in_other_case(name: str) -> Column:
        """Some row lacks the field, and somewhere on the page its name stands in a spelling that is not known."""
        known = "|".join(re.escape(spelling) for owner, spelling in sent if owner == name)
        other = f'"(?!(?:{known})")(?i:{re.escape(name)})"\\s*:'
        return F.exists("_rows", lambda e: value(row(e), name).isNull()) & F.col("body").rlike(other)

    other_case = reduce(lambda a, b: a | b, [in_other_case(name) for name in fields])
    slow = rows_in_any_case(envelope, sent, element)
    rows = F.when(other_case, slow).otherwise(F.col("_rows"))
    picked = [value(F.col("_row"), name).alias(name) for name in fields]
    return (
        parsed.select(*keep, F.explode(rows).alias("_element"))
        .select(*keep, row(F.col("_element")).alias("_row"))
        .select(*keep, *picked)
    )


def rows_in_any_case(envelope: Envelope, sent: list[tuple[str, str]], element: str) -> Column:
    """The rows of a page whose names are spelled in another letter case.

    Each row is parsed to a map, which costs several times the parse to known names, so it
    is done only for pages on which a field is there by name and yet was not found.
    """
    nothing = F.lit(None).cast("string")

    def find(entries: Column, name: str) -> Column:
        return F.get(F.filter(entries, lambda entry: F.lower(entry["key"]) == name.lower()), 0)["value"]

    def as_struct(e: Column) -> Column:
        entries, taken, values = F.map_entries(envelope.row(e)), set(), []
        for i, (name, _) in enumerate(sent):
            values.append((nothing if name in taken else find(entries, name)).alias(f"f{i}"))
            taken.add(name)
        found = F.struct(*values)
        return F.struct(found.alias("row")) if envelope.row_field else found

    return F.transform(envelope.rows(envelope.parse("map<string, string>")), as_struct).cast(f"array<{element}>")


def raw_rows(pages: DataFrame, envelope: Envelope) -> DataFrame:
    """Every row as it was sent, all fields, as one JSON text per row."""
    body = envelope.parse("string")
    element = F.explode(envelope.rows(body)).alias("_element")
    return pages.select(element).select(envelope.row(F.col("_element")).alias("value"))


def page_sizes(pages: DataFrame, envelope: Envelope, keep: Iterable[str] = PAGE_COLUMNS) -> DataFrame:
    """One row per page without opening its rows: ``n``, ``has_rows``, ``truncated``."""
    body = envelope.parse("struct<`_`: boolean>")
    truncated = at_path(F.col("_body"), envelope.truncated_path) if envelope.truncated_path else F.lit(None)
    rows = envelope.rows(F.col("_body"))
    return pages.select(*keep, body.alias("_body")).select(
        *keep,
        F.when(rows.isNull(), 0).otherwise(F.size(rows)).cast("bigint").alias("n"),
        rows.isNotNull().alias("has_rows"),
        truncated.cast("boolean").alias("truncated"),
    )


def observed_fields(pages: DataFrame, envelope: Envelope) -> DataFrame:
    """The field names the rows really have, and how many rows have each.

    A look at a new source before its spec is written, in place of schema inference.
    """
    name = F.explode(F.json_object_keys("value")).alias("field")
    return raw_rows(pages, envelope).select(name).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
