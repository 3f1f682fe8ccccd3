"""Line dedup over content-defined chunks of lines.

A rolling hash runs over every two lines that follow each other, blank lines aside. A chunk is a longest run of lines
whose windows all occur elsewhere as well, in one document or in many; its boundaries lie where the rolling hash stops
being a repeated one. They depend on the chunk's own lines only, not on what stands before or after it nor on how
far the text's start is, so no passage of two or more lines that occurred before is missed. Windows are matched by
their hash first; those that repeat are then compared byte by byte.

Only DataFrame and SQL functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callharmony.llm.tables import BROADCAST_ROWS, broadcast_if_small, column, written


def window_hash(above: str, below: str) -> Column:
    """The hash of a line, rolled on by the next one."""
    return F.xxhash64(above, below)


def _lined(keyed: DataFrame) -> DataFrame:
    """``keyed`` with its ``lines`` and the places ``at`` of those that are not blank."""
    lined = keyed.withColumn("lines", F.split("text", "\n", -1))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    return lined.withColumn("at", F.filter(places, lambda i: F.get(F.col("lines"), i).rlike(r"\S")))


def _windows(lined: DataFrame) -> DataFrame:
    """``doc_id, text_key, window_no, window_hash``: lines that are not blank, each with the next one."""
    filled = lined.withColumn("body", F.transform("at", lambda i: F.get(F.col("lines"), i)))
    below = F.slice("body", 2, F.greatest(F.size("body") - 1, F.lit(0)))
    zipped = filled.select("doc_id", "text_key", F.arrays_zip(F.col("body").alias("above"), below.alias("below")).alias("zipped"))
    # The outer form, since Spark derives a filter from the other one and moves it, inlined, to the scan.
    exploded = zipped.select("doc_id", "text_key", F.posexplode_outer("zipped").alias("window_no", "pair"))
    # The last line has none below it.
    pairs = exploded.select("doc_id", "text_key", "window_no", "pair.above", "pair.below").where("below IS NOT NULL")
    return pairs.select("doc_id", "text_key", "window_no", window_hash("above", "below").alias("window_hash"))


def _again(windows: DataFrame, told_by: list[str], purpose: str) -> DataFrame:
    """Those of ``windows`` that are not alone in what they are ``told_by``, with ``again``: it occurred before.

    The order of occurrences is by id, nulls last, then text, then position.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "window_no")
    firsts = windows.groupBy(*told_by).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    # Written, so that the join has an exchange of its own, whose large partitions Spark can split.
    first = written(firsts.where("n > 1").drop("n"), purpose)
    # A line three times in a row is a window that overlaps its own first occurrence, not a second one.
    same_text = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    is_first = same_text & (F.col("window_no") <= F.col("first.window_no") + 1)
    return windows.join(first, told_by).select(*windows.columns, (~is_first).alias("again"))


def _per_text(rows: DataFrame, value: Column, name: str, purpose: str) -> DataFrame:
    found = written(rows.groupBy("doc_id", "text_key").agg(F.collect_set(value).alias(name)), purpose)
    return found.withColumnsRenamed({"doc_id": "g_id", "text_key": "g_key"})


def _with(rows: DataFrame, found: DataFrame) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key"))
    return rows.join(found, same, "left").drop("g_id", "g_key")


def repeats(keyed: DataFrame) -> DataFrame:
    """``keyed`` with its lines and ``again``: the numbers of its windows that occurred before (null: none)."""
    marked = _again(_windows(_lined(keyed)), ["window_hash"], "first-windows")
    by_hash = _per_text(marked, F.struct("window_no", "window_hash", "again"), "by_hash", "repeats")
    # Texts move once, whatever the number of repeats.
    texts = _lined(written(_with(keyed, by_hash.hint("merge")), "marked-texts"))
    exploded = texts.select("doc_id", "text_key", "lines", "at", F.explode("by_hash").alias("seen"))
    above, below = (F.get(F.col("lines"), F.get(F.col("at"), F.col("seen.window_no") + i)) for i in (0, 1))
    # No line holds a line break, so joined lines are told apart from all others.
    window = F.concat(above, F.lit("\n"), below).alias("window")
    found = exploded.select("doc_id", "text_key", "seen.window_no", "seen.window_hash", window)
    # Grouping by the lines themselves compares bytes: windows that only share a hash are found here.
    shared = found.select("window_hash", "window").distinct().groupBy("window_hash").agg(F.count(F.lit(1)).alias("texts"))
    shared = broadcast_if_small(written(shared.where("texts > 1").select("window_hash"), "shared-hashes"))
    # These are told apart by their bytes; for all others the hash says as much.
    apart = _again(found.join(shared, "window_hash"), ["window"], "first-shared")
    unsure = found.join(shared, "window_hash").select("doc_id", "text_key", "window_no", F.lit(False).alias("again"))
    decided = written(unsure.unionByName(apart.where("again").select("doc_id", "text_key", "window_no", "again")), "decided")
    by_bytes = _per_text(decided, F.struct("window_no", "again"), "by_bytes", "told-apart")
    # As many windows bound their lists per text too.
    told = _with(texts, F.broadcast(by_bytes) if decided.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else by_bytes)
    unsure_no = F.coalesce(F.transform("by_bytes", lambda one: one["window_no"]), F.array().cast("array<int>"))
    sure = F.transform(F.filter("by_hash", lambda one: one["again"]), lambda one: one["window_no"])
    late = F.transform(F.filter("by_bytes", lambda one: one["again"]), lambda one: one["window_no"])
    again = F.concat(F.array_except(sure, unsure_no), F.coalesce(late, F.array().cast("array<int>")))
    return told.withColumn("again", again).drop("by_hash", "by_bytes")


def drop_repeated_chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id``, the remaining ``text``, ``n_lines`` before and ``n_removed`` of them.

    A line goes if it and a neighbour, blank lines between them aside, occurred before as neighbours: by id (nulls
    last), text and position, without overlap. Blank lines inside a removed chunk go with it. The first place of
    each line stays, and so does a repeated line whose neighbours are others. A chunk whose first occurrence begins or
    ends inside a repeat of another one loses the lines it shares with that there. A null text is an empty one, of one
    line. Rows that share id and text are treated alike, so their texts stay equal. A text all of whose lines go is empty.
    """
    body = F.coalesce(column(docs, text), F.lit(""))
    keyed = docs.select(column(docs, doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    cut, at = repeats(keyed), F.col("at")
    spans = F.transform("again", lambda k: F.sequence(F.get(at, k), F.get(at, k + 1)))
    none = F.array().cast("array<int>")
    kept_no = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce(F.flatten(spans), none))
    kept = cut.withColumn("kept_no", kept_no).withColumn("kept", F.transform("kept_no", lambda i: F.get(F.col("lines"), i)))
    n_lines = F.size("lines").cast("long")
    return kept.select("doc_id", F.array_join("kept", "\n").alias("text"), n_lines.alias("n_lines"), (n_lines - F.size("kept_no")).alias("n_removed"))
