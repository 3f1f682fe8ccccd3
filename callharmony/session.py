"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


# Files a task writes side by side before it sorts its rows; as many as Spark packs small files into one split.
OPEN_WRITERS = 32
# Rows of a table of calls that a task may hold: some hundred megabytes in a sort.
TASK_ROWS = 2**21


def build_session(app: str = "callharmony", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; everything else stays with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A task writes the few dataset folders side by side, without sorting its rows first.
        "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_WRITERS),
        # Range filters reach the paged source.
        "spark.sql.python.filterPushdown.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_conf(input_bytes: int) -> dict[str, str]:
    """Settings for a given input size, to pass to ``build_session``.

    Half a gigabyte per shuffle partition fits an executor's memory many times over, and
    adaptive execution joins partitions that turn out small.
    """
    partitions = min(max(input_bytes // 2**29, 200), 200_000)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
        "spark.sql.files.maxPartitionBytes": "256MB",
    }


def store_of(spark: SparkSession, path: str):
    """The store that holds ``path``, as Spark's JVM sees it, and the path there."""
    fs = spark._jvm.org.apache.hadoop.fs
    there, conf = fs.Path(path), spark._jsc.hadoopConfiguration()
    context = fs.FileContext.getFileContext(*([there.toUri()] if there.toUri().getScheme() else []), conf)
    return context, there


def input_bytes(spark: SparkSession, path: str) -> int:
    context, there = store_of(spark, path)
    return context.util().getContentSummary(there).getLength()


def fit_to(spark: SparkSession, path: str) -> None:
    """Settings of ``shuffle_conf`` for what lies at ``path``, if that needs more than the usual partitions."""
    size = input_bytes(spark, path)
    if size > 200 * 2**29:
        for key, value in shuffle_conf(size).items():
            spark.conf.set(key, value)


@contextmanager
def setting(spark: SparkSession, **least: int) -> Iterator[None]:
    """Settings of at least the given numbers, with ``__`` for a dot; those before come back at the end."""
    names = {name.replace("__", "."): number for name, number in least.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, number in names.items():
        spark.conf.set(name, str(max(int(before[name] or 0), number)))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def folders_side_by_side(spark: SparkSession) -> AbstractContextManager:
    """Writes into folders without a sort of each task's rows, also in a session that ``build_session`` did not make.

    Spark deals rows to tasks by their bytes as stored. Rows of mostly nulls take thirty times that in a sort's
    memory, so a sort before the write would hold far more than what a task is meant to.
    """
    return setting(spark, spark__sql__maxConcurrentOutputFileWriters=OPEN_WRITERS)


def dealt_by_rows(spark: SparkSession, rows: int) -> AbstractContextManager:
    """For the same reason, tasks that join or group ``rows`` rows are at least as many as hold ``TASK_ROWS`` each."""
    tasks = -(-rows // TASK_ROWS)
    usual = spark.sparkContext.defaultParallelism
    return setting(
        spark,
        spark__sql__shuffle__partitions=max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))),
        spark__sql__adaptive__coalescePartitions__minPartitionNum=max(tasks, usual),
        spark__sql__files__minPartitionNum=max(tasks, usual),
    )


def require_utc(spark: SparkSession) -> None:
    """Local call times are shifted relative to the session zone, so it has to be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, it is {zone}")


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    Without one, a folder of our own will do in local mode only; elsewhere executors would
    each write to a disk of their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="callharmony-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/callharmony/{purpose}-{uuid.uuid4().hex}"


def local_frame(spark: SparkSession, rows: list[dict], schema: StructType) -> DataFrame:
    """A few rows held by the driver. As Arrow data they are a local relation, not a Spark job."""
    columns = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=columns), schema)
