"""Exact dedup: heavy hitters are settled map-side, the long tail by one ordinary shuffle.

A Misra-Gries type sketch (Spark's ``approx_top_k``) over text digests finds every digest that may hold more
than one row in ``heavy_parts``. A second pass verifies these: it counts their rows exactly and picks the row
that stays. The verified winners, at most ``MAX_HEAVY`` rows, are broadcast, so rows of heavy groups are
decided where they are read. All other groups are smaller than the bound and take a shuffle by digest.

Only DataFrame and SQL functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callharmony.llm.tables import column, fresh, written

# A digest with at least one row in so many is a heavy hitter.
HEAVY_PARTS = 2048
# Entries of a sketch, a power of two; four times HEAVY_PARTS keeps the sketch's error below the bound.
TRACKED = 16_384
# More than HEAVY_PARTS because the sketch may overestimate.
MAX_HEAVY = 2 * HEAVY_PARTS
# Sketches are merged in two steps, so that no task takes in those of all others.
MERGERS = 32


def digest_of(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes; a null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def heavy_digests(rows: DataFrame, digest: str) -> list[str]:
    """Hex digests that may belong to heavy groups: no heavy one is missing, at most ``MAX_HEAVY`` are named."""
    sketched = (
        rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger"))
        .agg(F.expr(f"approx_top_k_accumulate(hex(`{digest}`), {TRACKED})").alias("sketch"), F.count(F.lit(1)).alias("n"))
        # By a constant key: a combiner without any key fails in tasks that get no sketch.
        .groupBy(F.lit(0).alias("all"))
        .agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"), F.sum("n").alias("n"))
        .where("n > 0")
        .select(F.expr(f"approx_top_k_estimate(sketch, {MAX_HEAVY})").alias("top"), "n")
    )
    heavy = sketched.select(F.explode("top").alias("top"), "n").where(f"top.count > 1 AND top.count * {HEAVY_PARTS} >= n")
    return [row[0] for row in heavy.select("top.item").collect()]


def winners(rows: DataFrame, digest: str, doc_id: str, heavy: list[str], row_no: str) -> DataFrame:
    """One row per heavy digest, from an exact count: which id and row stay and how many rows share the text."""
    names = rows.sparkSession.createDataFrame([(bytes.fromhex(h),) for h in heavy], "w_digest binary")
    # Nulls are the least, so a row with an id comes before all without.
    best = F.max(F.struct(F.col(f"`{doc_id}`").alias("w_keep"), F.col(f"`{row_no}`").alias("w_row")))
    return (
        rows.join(F.broadcast(names), column(rows, digest) == names.w_digest)
        .groupBy("w_digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("w_size"))
        .select("w_digest", "best.*", "w_size")
    )


def mark_tail(rows: DataFrame, won: DataFrame, digest: str, doc_id: str) -> DataFrame:
    """Rows of no heavy digest with ``keep_id``, ``group_size`` and ``kept`` (replaced where the names exist).

    Of the rows with one digest that with the largest id is kept; nulls rank lowest. Where several rows share
    text *and* id, one of them is kept.
    """
    given = [name for name in rows.columns if name.lower() not in ("keep_id", "group_size", "kept")]
    rows = rows.select([column(rows, name) for name in given])
    row_no, ids, key = fresh(rows, "row_no"), F.col(f"`{doc_id}`"), F.col(f"`{digest}`")
    by_text = Window.partitionBy(key)
    ranked = by_text.orderBy(ids.desc_nulls_last())
    return (
        rows.join(F.broadcast(won), column(rows, digest) == won.w_digest, "left_anti")
        .withColumn(row_no, F.row_number().over(ranked))
        .select(
            *[F.col(f"`{name}`") for name in given],
            F.first(ids).over(ranked).alias("keep_id"),
            F.count(F.lit(1)).over(by_text).alias("group_size"),
            (F.col(row_no) == 1).alias("kept"),
        )
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; no row is dropped.

    A null text is an empty text. An empty table gives no rows. Other columns play no part.
    """
    rows = docs.select(column(docs, doc_id).alias("doc_id"), digest_of(column(docs, text)).alias("digest"))
    # Numbered before they are written, so that a row's number stays what it is.
    rows = written(rows.withColumn("row_no", F.monotonically_increasing_id()), "digests")
    won = written(winners(rows, "digest", "doc_id", heavy_digests(rows, "digest"), "row_no"), "winners")
    tail = mark_tail(rows.drop("row_no"), won, "digest", "doc_id")
    heavy = rows.join(F.broadcast(won), rows.digest == won.w_digest)
    heavy = heavy.select("doc_id", "digest", F.col("w_keep").alias("keep_id"), F.col("w_size").alias("group_size"), (F.col("row_no") == F.col("w_row")).alias("kept"))
    return tail.unionByName(heavy).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row for each distinct text, all columns as they were."""
    digest = fresh(docs, "digest")
    keyed = docs.withColumn(digest, digest_of(column(docs, text)))
    slim = written(keyed.select(column(keyed, doc_id).alias("doc_id"), column(keyed, digest).alias("digest"), F.lit(0).alias("row_no")), "digests")
    won = written(winners(slim, "digest", "doc_id", heavy_digests(slim, "digest"), "row_no"), "winners")
    whole = F.struct(*[column(keyed, name) for name in docs.columns]).alias("row")
    first = keyed.select(whole, column(keyed, doc_id).alias("doc_id"), column(keyed, digest).alias("digest"))
    tail = mark_tail(first, won, "digest", "doc_id").where("kept")
    # Each task passes on one row of those that share a heavy text and the id that stays.
    heavy = first.join(F.broadcast(won), first.digest == won.w_digest).where(F.col("doc_id").eqNullSafe(F.col("w_keep")))
    best = heavy.groupBy("w_digest").agg(F.first("row").alias("row"))
    return tail.select("row.*").unionByName(best.select("row.*"))
