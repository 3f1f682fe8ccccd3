"""Upsert into a warehouse over JDBC: Spark loads a staging table, SQL merges it."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from callharmony.schema import CALL_SCHEMA, KEYS

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def _table(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a plain table name: {name!r}")
    return name


def staging_sql(target: str, staging: str) -> list[str]:
    """Make ``staging`` an empty table with the columns of ``target``."""
    target, staging = _table(target), _table(staging)
    return [
        f"DROP TABLE IF EXISTS {staging}",
        f"CREATE TABLE {staging} AS SELECT * FROM {target} LIMIT 0",
    ]


def upsert_sql(
    target: str,
    staging: str,
    keys: Sequence[str] = KEYS,
    columns: Sequence[str] = tuple(CALL_SCHEMA.names),
) -> list[str]:
    """Replace the target rows whose key is staged, and drop the staging table, in one transaction."""
    target, staging = _table(target), _table(staging)
    same_key = " AND ".join(f"{target}.{key} = {staging}.{key}" for key in keys)
    listed = ", ".join(columns)
    return [
        "BEGIN",
        f"DELETE FROM {target} USING {staging} WHERE {same_key}",
        f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {staging}",
        f"DROP TABLE {staging}",
        "COMMIT",
    ]


def write_jdbc(
    df: DataFrame,
    url: str,
    staging: str,
    pre: Sequence[str],
    post: Sequence[str],
    execute: Callable[[str], object],
    properties: dict[str, str] | None = None,
) -> None:
    """Run ``pre``, let the executors load ``staging`` in parallel, run ``post``.

    ``execute`` runs one statement on a connection that the caller holds open, so that the
    statements of ``post`` share a transaction. On an error the target has not changed.
    """
    for statement in pre:
        execute(statement)
    df.write.jdbc(url, _table(staging), mode="append", properties=properties or {})
    try:
        for statement in post:
            execute(statement)
    except Exception:
        execute("ROLLBACK")
        raise
