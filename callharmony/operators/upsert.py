"""Keyed delete, upsert, and the one-pass form of a sequence of upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from callharmony.schema import KEYS


def has_null_key(keys: Sequence[str] = KEYS) -> Column:
    """True for a row that no key comparison can match."""
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def distinct_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The non-null keys, once each; a key with many rows shrinks to one before the shuffle.

    Grouping by the keys as one struct leaves the following join to place its own
    exchange, and only with that can adaptive execution split a hot key of the other side.
    """
    keyed = df.where(~has_null_key(keys))
    return keyed.groupBy(F.struct(*keys).alias("_key")).agg(F.lit(True).alias("_one")).select("_key.*")


def delete_matching(target: DataFrame, keys_df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Target rows whose key is not in ``keys_df``. Rows with a null key always stay.

    Those rows could only pile up in one partition per dataset, so they go around the join.
    """
    unmatched = target.where(~has_null_key(keys)).join(distinct_keys(keys_df, keys), list(keys), "left_anti")
    return unmatched.select(*target.columns).unionByName(target.where(has_null_key(keys)))


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same columns; the optimizer drops whatever made them."""
    return df.limit(0)


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Delete the target rows whose key the batch holds, then add the whole batch.

    Rows of the batch that share a key are all added.
    """
    return delete_matching(target, batch, keys).unionByName(batch)


def fold_pages(df: DataFrame, keys: Sequence[str] = KEYS, seq: str | Sequence[str] = "page_seq") -> DataFrame:
    """What is left of ``df`` after upserting its pages one by one in order of ``seq``.

    For each key the rows of its last page stay, all of them; rows with a null key all
    stay. The last page per key comes from an aggregate that combines before its shuffle.
    The rows are matched on key and page together, so the rows of a hot key, and of the
    null key, spread over as many partitions as they have pages.
    """
    seq = [seq] if isinstance(seq, str) else list(seq)
    # The maximum of one number is a hash aggregate, that of a struct has to sort.
    last = F.max(seq[0]) if len(seq) == 1 else F.max(F.struct(*seq))
    latest = (
        df.where(~has_null_key(keys))
        .groupBy(*keys)
        .agg(last.alias("_last"))
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            *[(F.col("_last") if len(seq) == 1 else F.col(f"_last.{s}")).alias(f"_last_{s}") for s in seq],
            F.lit(True).alias("_is_last"),
        )
    )
    same_key = [F.col(k) == F.col(f"_key_{k}") for k in keys]
    same_page = [F.col(s).eqNullSafe(F.col(f"_last_{s}")) for s in seq]
    joined = df.join(latest, reduce(lambda a, b: a & b, same_key + same_page), "left")
    return joined.where(F.col("_is_last") | has_null_key(keys)).select(*df.columns)
