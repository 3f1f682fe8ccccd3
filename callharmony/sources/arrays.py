"""One huge JSON array, read by many tasks although it has no line breaks.

Spark reads a text in byte ranges at any separator, here the closing brace. Where a range begins is not known from the
range: it may be inside a string, and at any depth. So each range is scanned for both cases, with the change of depth
in either; running sums over a file's ranges then give the state each one really begins in, and a second scan cuts
the array's elements at commas of depth one. An element that spans ranges is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from callharmony.session import workspace
from callharmony.sources.landed import located

END = "}"
# Elements in a body, and bytes after which one is closed with fewer.
ROWS, BYTES = 1000, 8 * 2**20
_QUOTE, _BACKSLASH, _COMMA = b'"', b"\\", b","
_OPEN, _CLOSE = (ord("["), ord("{")), (ord("]"), ord("}"))
_WHITE = b" \t\r\n"


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text that begins with no escape: how many quotes stand up to each byte, and what each does to the depth."""
    quotes = np.flatnonzero(text == _QUOTE[0])
    escaped = quotes[(quotes > 0) & (text[quotes - 1] == _BACKSLASH[0])]
    if len(escaped):
        places = np.arange(len(text))
        last_other = np.maximum.accumulate(np.where(text != _BACKSLASH[0], places, -1))
        # An odd number of backslashes before a quote makes it a letter.
        odd = (escaped - 1 - last_other[escaped - 1]) % 2 == 1
        quotes = np.setdiff1d(quotes, escaped[odd], assume_unique=True)
    is_quote = np.zeros(len(text), np.int64)
    is_quote[quotes] = 1
    return np.cumsum(is_quote), np.isin(text, _OPEN).astype(np.int64) - np.isin(text, _CLOSE)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """The bytes of each batch that belong to one range of one file; the ends of all segments are put back."""
    for batch in batches:
        keys = list(zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True))
        values, at = batch["value"].to_pylist(), 0
        while at < len(keys):
            upto = at
            while upto < len(keys) and keys[upto] == keys[at]:
                upto += 1
            yield keys[at], (END.join(values[at:upto]) + END).encode("utf-8", "surrogatepass")
            at = upto


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its number of quotes and, begun outside or inside a string, the change of depth."""
    found: dict[tuple[str, int], list] = {}
    for key, body in _ranges(batches):
        text = np.frombuffer(body, np.uint8)
        quotes, depth = _marks(text)
        row = found.setdefault(key, [0, 0, 0, body.lstrip(_WHITE)[:1] == b"["])
        outside = quotes % 2 == row[0] % 2  # outside a string, had the range begun outside
        row[0] += int(quotes[-1])
        row[1] += int(depth[outside].sum())
        row[2] += int(depth[~outside].sum())
    rows = [{"path": key[0], "start": key[1], "quotes": v[0], "outside": v[1], "inside": v[2], "opens": v[3]} for key, v in found.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows)


@dataclass
class _Cutter:
    """Cuts one range into elements; pieces of elements that began before it or go on after it are told apart."""

    path: str
    start: int
    in_string: bool
    depth: int
    kind: str = "head"
    held: list[bytes] = field(default_factory=list)
    rows: list[bytes] = field(default_factory=list)
    size: int = 0

    def add(self, body: bytes) -> Iterator[dict]:
        text = np.frombuffer(body, np.uint8)
        quotes, change = _marks(text)
        outside = (quotes + self.in_string) % 2 == 0
        change = np.where(outside, change, 0)
        depth = self.depth + np.cumsum(change)
        opened = (change > 0) & (depth == 1) & (text == _OPEN[0])
        closed = (change < 0) & (depth == 0) & (text == _CLOSE[0])
        cuts = np.flatnonzero(opened | closed | (outside & (depth == 1) & (text == _COMMA[0])))
        at = 0
        for cut in cuts.tolist():
            self.held.append(body[at:cut])
            at = cut + 1
            yield from self._end(opened[cut])
        self.held.append(body[at:])
        self.in_string, self.depth = bool((quotes[-1] + self.in_string) % 2), int(depth[-1])

    def _end(self, begins: bool) -> Iterator[dict]:
        element, self.held = b"".join(self.held).strip(_WHITE), []
        if self.kind == "head":
            self.kind = "rows"
            if not begins:
                yield self._row("head", element)
        elif element and not begins:
            self.rows.append(element)
            self.size += len(element)
            if len(self.rows) >= ROWS or self.size >= BYTES:
                yield self._body()

    def _body(self) -> dict:
        body, self.rows, self.size = b"[" + b",".join(self.rows) + b"]", [], 0
        return self._row("rows", body)

    def finish(self) -> Iterator[dict]:
        if self.rows:
            yield self._body()
        if self.depth > 0 or self.in_string:
            yield self._row("whole" if self.kind == "head" else "tail", b"".join(self.held))

    def _row(self, kind: str, body: bytes) -> dict:
        return {"path": self.path, "start": self.start, "kind": kind, "body": body.decode("utf-8", "surrogatepass")}


def read_array_files(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Files that hold one JSON array each, as pages: ``PAGE_SCHEMA`` and ``part``.

    A file's elements are dealt into bodies of their own, told apart by ``part``; the audit adds the parts of a page
    up. A file that does not begin with an array, or breaks off before its end, has a part without rows, by which the
    audit knows it. The result is written once, so that later steps do not scan the array again.
    """
    reader = spark.read.option("lineSep", END).option("recursiveFileLookup", True)
    text = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    summaries = text.mapInArrow(_summaries, "path string, start long, quotes long, outside long, inside long, opens boolean")
    place = workspace(spark, "array-ranges")
    summaries.write.parquet(place)  # one row per range
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spark.read.schema(summaries.schema).parquet(place)
    ranges = ranges.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    ranges = ranges.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    ranges = ranges.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    files = ranges.groupBy("path").agg(F.min_by("opens", "start").alias("opens"), F.sum("change").alias("left"), (F.sum("quotes") % 2).alias("quoted"))
    # An end is put after the last segment too, so a whole array is left one below.
    broken = files.where("NOT opens OR left <> -1 OR quoted <> 0").select("path")
    begun = {(row["path"], row["start"]): (row["in_string"], row["depth"]) for row in ranges.collect()}  # as many as there are splits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("body", pa.string())])
        cutter = None
        for key, body in _ranges(batches):
            out = []
            if cutter is None or key != (cutter.path, cutter.start):
                out += cutter.finish() if cutter else ()
                cutter = _Cutter(*key, *begun[key], kind="head" if begun[key][1] > 0 else "rows")
            out += cutter.add(body)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if cutter:
            yield pa.RecordBatch.from_pylist(list(cutter.finish()), schema)

    place = workspace(spark, "array-parts")
    pieces = text.mapInArrow(cut, "path string, start long, kind string, body string")
    pieces.write.parquet(place)
    pieces = spark.read.schema(pieces.schema).parquet(place)
    # Two pieces a range at most. An element begins with a tail, goes on over whole ranges and ends with a head.
    in_order = Window.partitionBy("path").orderBy("start", F.col("kind") == "tail")
    spanning = pieces.where("kind <> 'rows'").withColumn("element", F.sum((F.col("kind") == "tail").cast("int")).over(in_order))
    joined = spanning.groupBy("path", "element").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("kind") == "tail").alias("last"), "body"))).alias("pieces"), F.max(F.col("kind") == "head").alias("ends")
    )
    element = F.array_join(F.transform("pieces", lambda piece: piece["body"]), "")
    rows = joined.where("ends").select("path", F.concat(F.lit("["), element, F.lit("]")).alias("body"))
    no_rows = broken.select("path", F.lit("{}").alias("body"))
    bodies = pieces.where("kind = 'rows'").select("path", "body").unionByName(rows).unionByName(no_rows)
    # An empty array has no elements, but is a page all the same.
    bodies = bodies.unionByName(files.select("path", F.lit("[]").alias("body")))
    place = workspace(spark, "array-pages")
    pages = located(bodies, F.col("path"), F.col("body"), dataset).withColumn("part", F.monotonically_increasing_id())
    pages.write.parquet(place)
    return spark.read.schema(pages.schema).parquet(place)
