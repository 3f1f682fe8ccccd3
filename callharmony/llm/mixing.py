"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the characters over its real share. Every document is written
as many times as a Poisson variable with that mean says; its value is the inverse of the distribution at a number
between 0 and 1 that a hash of seed and document gives, so a run can be repeated. All copies are then ordered by
another hash and dealt over the cluster in that order.

Only DataFrame functions run here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from callharmony.llm.tables import broadcast_if_small, column, fresh, written

# Weights where none are given: a source's characters to this power.
TEMPERATURE = 0.7
# A Poisson variable with a larger mean is the sum of several with at most this mean.
STEP = 32.0
# The values a step can take; beyond them lies less than what the hash can tell apart.
VALUES = 128


def unit(key: Column, bits: int = 52) -> Column:
    """A number strictly between 0 and 1 from the MD5 of a text."""
    head = F.conv(F.substring(F.md5(key), 1, bits // 4), 16, 10).cast("long")
    return (head.cast("double") + 0.5) / float(2**bits)


def rates(docs: DataFrame, weights: dict[str | None, float] | None, budget: float, text: str, source: str) -> DataFrame:
    """``source_key, rate, steps, cdf``: one row per source.

    ``cdf`` is the distribution of one step. A source that ``weights`` does not name is left out (rate 0), and all are
    if none of the named ones is present. A weight below zero, or that is no finite number, is refused.
    """
    wrong = [weight for weight in (weights or {}).values() if not 0 <= weight < math.inf]
    if wrong:
        raise ValueError(f"weights are finite numbers from zero on, not {wrong[0]}")
    key = F.coalesce(F.concat(F.lit("="), column(docs, source).cast("string")), F.lit("null"))
    size = F.length(F.coalesce(column(docs, text), F.lit(""))).cast("long")
    sizes = written(docs.select(key.alias("source_key"), size.alias("n")).groupBy("source_key").agg(F.sum("n").alias("n")), "mixing-sizes")
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    else:
        named = {"null" if name is None else f"={name}": float(weight) for name, weight in weights.items()}
        share = F.lit(0.0)
        for name, weight in named.items():
            share = F.when(F.col("source_key") == name, F.lit(weight)).otherwise(share)
    shared = sizes.withColumn("share", share)
    total = shared.agg(F.sum("n").alias("total_n"), F.sum("share").alias("total_share"))
    rate = F.lit(budget) * F.col("total_n") * F.col("share") / F.nullif("total_share", F.lit(0.0)) / F.nullif("n", F.lit(0))
    rated = shared.join(F.broadcast(total)).select("source_key", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    steps = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("steps")
    first = F.exp(-mean)
    # Each value's probability is the one before times mean / value.
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(VALUES)),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )
    # Where the distribution has come as near to 1 as numbers can, its values repeat.
    return written(rated.withColumn("steps", steps).select("source_key", "rate", "steps", F.array_distinct(grown).alias("cdf")), "mixing-rates")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    budget: float = 1.0,
    seed: int = 0,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``docs`` with each row repeated by its count, plus ``copy`` (from 1) and ``place``, in the order of ``place``.

    ``budget`` is the expected number of characters over those of ``docs``. A row without an id is known by its
    text; rows that share the key share the count. Sources without any characters and those without a weight give
    nothing; weights of which none names a present source give no rows, and negative ones an error. Given columns named ``copy`` or ``place`` are replaced.
    """
    given = [name for name in docs.columns if name.lower() not in ("copy", "place")]
    limits = rates(docs, weights, budget, text, source)
    key, count, group = fresh(docs, "mix_key"), fresh(docs, "mix_count"), fresh(docs, "mix_source")
    limits = limits.select(F.col("source_key").alias(group), F.struct("rate", "steps", "cdf").alias(count))
    keyed = docs.select(
        *[column(docs, name) for name in given],
        F.coalesce(F.concat(F.lit("="), column(docs, source).cast("string")), F.lit("null")).alias(group),
        F.coalesce(column(docs, doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(column(docs, text), F.lit(""))))).alias(key),
    ).join(broadcast_if_small(limits, 5_000), group)

    def drawn(step: Column) -> Column:
        u = unit(F.concat(F.lit(f"{seed}:"), F.col(key), F.lit(":"), step.cast("string")))
        return F.size(F.filter(F.col(count)["cdf"], lambda c: c < u))

    total = F.aggregate(F.sequence(F.lit(1), F.col(count)["steps"]), F.lit(0), lambda acc, step: acc + drawn(step))
    counted = keyed.withColumn(count, F.when(F.col(count)["rate"] > 0, total).otherwise(F.lit(0)))
    # The outer form, since Spark derives a filter from the other one, and would count again for it.
    numbers = F.explode_outer(F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count)))).alias("copy")
    copies = counted.select(*[F.col(f"`{name}`") for name in given], F.col(key), numbers).where("copy IS NOT NULL")
    place = unit(F.concat(F.lit(f"{seed}:place:"), F.col(key), F.lit(":"), F.col("copy").cast("string")))
    placed = copies.select(*[F.col(f"`{name}`") for name in given], "copy", place.alias("place"))
    # Copies of rows that share the key share their places; a number of their own splits them between ranges.
    row_no = fresh(placed, "row_no")
    spread = placed.withColumn(row_no, F.monotonically_increasing_id()).repartitionByRange("place", row_no)
    return spread.sortWithinPartitions("place").drop(row_no)
