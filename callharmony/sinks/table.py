"""The table of calls: Parquet, split by dataset and by a hash of the key.

    <path>/buckets=<n>/dataset=<label>/bucket=<i>/*.parquet
    <path>/merged/                what is to take the place of its buckets
    <path>/staging/<name>/

An upsert reads and writes only the buckets that its keys fall into; Spark's dynamic partition overwrite puts them in
place and leaves the files of all others as they are. Spark swaps buckets one after another, so the merged rows are
kept until all are swapped: a writer that finds them finishes what an earlier one began, which gives the same rows
however far that one came.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from callharmony.operators.project import conform
from callharmony.operators.upsert import delete_matching, empty_like, fold_pages, has_null_key
from callharmony.schema import CALL_SCHEMA, KEYS, ORDER
from callharmony.session import TASK_ROWS, dealt_by_rows, folders_side_by_side, input_bytes, store_of, workspace

# A stored row also knows its page, so that pages may be added in any order.
STORED_SCHEMA = StructType([*CALL_SCHEMA.fields, StructField("run_id", StringType()), StructField("page_seq", IntegerType())])
BUCKET_SCHEMA = StructType([*STORED_SCHEMA.fields, StructField("bucket", IntegerType())])
PLACE = ("dataset", "bucket")

# What the buckets of a batch hold afterwards, from what they hold now (None: there is no table yet) and the batch.
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]

# Where no number of buckets is given: so many, or what gives buckets of this size if a first batch is far larger.
LEAST_BUCKETS, MAX_BUCKETS, BUCKET_BYTES = 8, 16_384, 256 * 2**20


def page_order(runs: int) -> Sequence[str]:
    """Within one run the page number alone decides, and its maximum is the cheaper aggregate."""
    return ORDER[1:] if runs <= 1 else ORDER


class CallTable:
    """One table at ``path``, in storage that all executors share. One writer at a time.

    The first write creates it with ``buckets`` buckets a dataset, or as many as its size asks for, and ``rebucket``
    changes them. A bucket should be some hundred megabytes: more buckets make a small upsert cheaper, fewer keep files
    large. While an upsert swaps its buckets, a reader may see some of them before and some after it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self._wanted = spark, path.rstrip("/"), buckets
        if buckets is not None:
            _checked(buckets)

    @property
    def buckets(self) -> int | None:
        """Buckets per dataset, or None if there is no table yet."""
        context, path = store_of(self.spark, self.path)
        if not context.util().exists(path):
            return None
        names = (status.getPath().getName() for status in context.util().listStatus(path))
        # Two, if dealing anew broke off before the old buckets were deleted: both hold the same rows.
        return max((int(found[1]) for found in map(re.compile(r"buckets=(\d+)").fullmatch, names) if found), default=None)

    def read(self) -> DataFrame:
        """The canonical rows."""
        if self.buckets is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._stored().select(*CALL_SCHEMA.names)

    def upsert(self, batch: DataFrame) -> int:
        """Replace the rows whose key is in the batch and add the whole batch; returns how many buckets were written."""

        def replaced(target: DataFrame | None, rows: DataFrame) -> DataFrame:
            return rows if target is None else delete_matching(target, rows.select(*KEYS)).unionByName(rows)

        return self._merge(batch, replaced)

    def add_pages(self, rows: DataFrame) -> int:
        """Add canonical rows of some pages, in whatever order pages come; of a key the rows of its last page stay.

        A page that was added before is replaced, so a repeated call changes nothing.
        """

        def folded(target: DataFrame | None, rows: DataFrame) -> DataFrame:
            if target is not None:
                pages = rows.select("dataset", *ORDER).distinct()
                same = reduce(lambda a, b: a & b, [target[name].eqNullSafe(pages[name]) for name in pages.columns])
                rows = target.join(pages, same, "left_anti").unionByName(rows)
            return fold_pages(rows, KEYS, ORDER)

        return self._merge(rows, folded)

    def rebucket(self, buckets: int) -> None:
        """Deal all rows into more buckets, once the table has grown. What was there stays until all is written."""
        self.recover()
        old = self.buckets
        if old is None or _checked(buckets) <= old:
            raise ValueError(f"the table has {old} buckets a dataset, and only more can be asked for")
        self._deal(self._placed(self._stored().drop("bucket"), buckets), buckets)
        context, path = store_of(self.spark, f"{self.path}/buckets={old}")
        context.delete(path, True)

    def recover(self) -> None:
        """Finish an upsert that broke off while its buckets were swapped."""
        context, merged = store_of(self.spark, f"{self.path}/merged")
        if context.util().exists(store_of(self.spark, f"{self.path}/merged/_SUCCESS")[1]):
            self._swap()
        elif context.util().exists(merged):
            context.delete(merged, True)  # it broke off before its rows were whole

    def stage(self, rows: DataFrame, name: str, seen: Observation, metrics: Sequence[Column]) -> DataFrame:
        """Write rows to a staging folder, dropping what was there, and read them back."""
        path = f"{self.path}/staging/{name}"
        rows.observe(seen, *metrics).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear_staging(self, name: str) -> None:
        """Leave an empty staging folder behind."""
        path = f"{self.path}/staging/{name}"
        empty_like(self.spark.read.schema(STORED_SCHEMA).parquet(path)).write.mode("overwrite").parquet(path)

    def _merge(self, batch: DataFrame, merge: Merge) -> int:
        self.recover()
        buckets = self.buckets or self._wanted or LEAST_BUCKETS
        stored = conform(batch, STORED_SCHEMA).withColumns(
            {"run_id": F.coalesce("run_id", F.lit("")), "page_seq": F.coalesce("page_seq", F.lit(-1))}
        )
        placed = self._placed(stored, buckets)
        if self.buckets is None:
            self._deal(merge(None, placed), buckets)
            datasets, size = self._stored().select("dataset").distinct().count(), input_bytes(self.spark, self.path)
            fitting = min(MAX_BUCKETS, size // (BUCKET_BYTES * max(datasets, 1)))
            if self._wanted is None and fitting > 4 * buckets:
                self.rebucket(fitting)
            return len({file.rpartition("/")[0] for file in self._stored().inputFiles()})
        path, seen = workspace(self.spark, "batch"), Observation()
        # The batch is computed once, and its buckets are told by the write: at most those of the table.
        told = placed.observe(seen, F.collect_set(F.struct(*PLACE)).alias("places"), F.count(F.lit(1)).alias("rows"))
        told.write.option("maxRecordsPerFile", TASK_ROWS).parquet(path)
        if not seen.get["places"]:
            return 0
        rows = self.spark.read.schema(BUCKET_SCHEMA).parquet(path)
        target = self._stored().where(_in_places(seen.get["places"]))
        with dealt_by_rows(self.spark, target.count() + seen.get["rows"]):  # a count reads no rows
            self._write(merge(target, rows), f"{self.path}/merged")
        self._swap()
        return len(seen.get["places"])

    def _deal(self, placed: DataFrame, buckets: int) -> None:
        """Write a whole table of so many buckets, which is there once its folder has its name."""
        context, dealt = store_of(self.spark, f"{self.path}/dealt")
        self._write(placed, f"{self.path}/dealt")
        rename = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(dealt, store_of(self.spark, f"{self.path}/buckets={buckets}")[1], rename)

    def _write(self, rows: DataFrame, path: str) -> None:
        # A bucket in which one key has many rows is split by Spark, small ones share a task.
        split = rows.select(*BUCKET_SCHEMA.names).hint("rebalance", *PLACE)
        with folders_side_by_side(self.spark):
            split.write.mode("overwrite").partitionBy(*PLACE).parquet(path)

    @staticmethod
    def _placed(rows: DataFrame, buckets: int) -> DataFrame:
        """Rows with their bucket. Those without a key, which no key can replace, are spread."""
        hashed = F.when(has_null_key(), F.xxhash64(*STORED_SCHEMA.names)).otherwise(F.xxhash64(*KEYS))
        return rows.withColumn("bucket", F.pmod(hashed, F.lit(buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(BUCKET_SCHEMA).parquet(f"{self.path}/buckets={self.buckets}")

    def _swap(self) -> None:
        """Put the merged buckets in the place of the old ones; their files are written anew, so this can be repeated."""
        merged = self.spark.read.schema(BUCKET_SCHEMA).parquet(f"{self.path}/merged")
        writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE)
        with folders_side_by_side(self.spark):
            writer.parquet(f"{self.path}/buckets={self.buckets}")
        context, path = store_of(self.spark, f"{self.path}/merged")
        context.delete(path, True)


def _checked(buckets: int) -> int:
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"a table has 1 to {MAX_BUCKETS} buckets a dataset")
    return buckets


def _in_places(places: list) -> Column:
    """Whether a row lies in one of the given buckets, so that Spark lists and reads no others."""
    by_dataset: dict[str | None, list[int]] = {}
    for dataset, bucket in places:
        by_dataset.setdefault(dataset, []).append(bucket)
    wanted = [F.col("dataset").eqNullSafe(F.lit(dataset)) & F.col("bucket").isin(found) for dataset, found in by_dataset.items()]
    return reduce(lambda a, b: a | b, wanted)
