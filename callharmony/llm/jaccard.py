"""Exact n-gram Jaccard join in the metric space of shingle sets.

Distance is one minus Jaccard similarity, which obeys the triangle inequality. In this space nearly every document
has distance one from any pivot, so cells of far-away pivots would hold everything. Therefore the first regions
are those of the rarest shingles: two sets closer than ``r`` share one of their rarest few, and only sets that
do so can be in one region.

1. Documents with equal shingle sets become one point.
2. A point with more unique shingles than a partner could lack has no link and leaves. Uniqueness is first counted
   for a fixed share of all shingles, where most points leave, then for all shingles of the rest.
3. Each region's first pivot is the point with the fewest shingles of its own. Distances to it are computed once per pair of points, whatever
   number of regions they share. Points within ``r`` are linked to it; a linked point that is nearer to the pivot
   than all others in the region by more than ``r`` cannot link to those and leaves.
4. Regions that still hold points of several components join recursively: points outside a region's largest
   component become pivots, and a pivot meets only points of other components, of fitting size, inside the window
   that the triangle inequality leaves around its own distance to the earlier pivot. Pivots leave their region,
   until each region holds one component.

The links found connect exactly what all links would connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from callharmony.llm.components import components
from callharmony.llm.tables import broadcast_if_small, column, written

N = 5
PERCENT = 75
# Uniqueness is counted first for the shingles below this share of the hash range.
FIRST_SHARE = 0.4
# If more points of a region are outside its largest component, half of them become pivots in a round, not all.
SMALL_REGION = 64

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Odd numbers for the places of a window, drawn once.
_PLACES = np.random.default_rng(20240601).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """A document's set as sorted distinct 64-bit hashes; empty without words.

    A-Z are lower-cased, words are what ASCII white space parts. With fewer than ``n`` words the whole sequence is
    the one shingle.
    """
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64).view(np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(hashed) - n + 1
    mixed = np.zeros(count, np.uint64)
    for place in range(n):
        mixed += hashed[place : place + count] * _PLACES[place]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _PLACES[place + 32]
    return np.unique((mixed ^ (mixed >> np.uint64(32))).view(np.int64))


def _map(df: DataFrame, of_text, schema: str) -> DataFrame:
    """``of_text(texts, other columns)`` gives the output columns of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield of_text(batch.slice(at, 500))

    return df.mapInArrow(run, schema)


def _key(values: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(values.tobytes()), "little", signed=True)


def _points(docs: DataFrame, n: int) -> DataFrame:
    """Per row: id, hash of the text, size of its set, and the set's 64-bit and 128-bit digests."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(text.as_py(), n) for text in batch["text"]]
        return pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["text_key"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_key(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            ],
            ["doc_id", "text_key", "n", "set_key", "digest"],
        )

    return _map(docs, of, "doc_id long, text_key long, n long, set_key long, digest binary")


def _sampled(docs: DataFrame, n: int) -> DataFrame:
    """``(shingle, set_key)`` for the shingles in the first share of the hash range."""
    bound = np.int64(-(2**63) + int(FIRST_SHARE * 2**64))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = {_key(s): s[s < bound] for s in (shingles(text.as_py(), n) for text in batch["text"])}
        owners = np.repeat(np.array(list(sets), np.int64), [len(s) for s in sets.values()])
        values = np.concatenate([*sets.values(), np.empty(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(owners)], ["shingle", "set_key"])

    return _map(docs.select("text"), of, "shingle long, set_key long")


def _sets(points: DataFrame, n: int) -> DataFrame:
    """``points(sid, text)`` with the sets in full: ``sid, shingles``."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(text.as_py(), n) for text in batch["text"]]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate([*sets, np.empty(0, np.int64)])
        return pa.RecordBatch.from_arrays([batch["sid"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["sid", "shingles"])

    return _map(points, of, "sid long, shingles array<long>")


def _need(size: Column, percent: int) -> Column:
    """The least overlap a set of this size has with a linked one."""
    return F.ceil(size * percent / F.lit(100.0)).cast("long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` with their distance and whether they link, counted on the whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("total"))
    union = F.col("total") - F.col("i")
    return counted.select("a", "b", (1 - F.col("i") / union).alias("d"), (100 * F.col("i") >= percent * union).alias("linked"))


def _regions(sets: DataFrame, percent: int) -> DataFrame:
    """``region, sid, n, own, place``: the regions of the rarest shingles. A region is named by its shingle.

    ``own`` is the number of shingles no other set has, ``place`` the shingle's place in the set's order of rarity.
    """
    sized = sets.select("sid", F.size("shingles").cast("long").alias("n"), "shingles")
    entries = sized.select("sid", "n", F.explode("shingles").alias("region"))
    shared = entries.groupBy("region").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = (
        entries.join(shared, "region")
        .groupBy("sid", "n")
        .agg(F.array_sort(F.collect_list(F.struct("f", "region"))).alias("by_rarity"))
    )
    # Unique shingles come first in the order of rarity, so they use up part of the prefix.
    own = F.col("n") - F.size("by_rarity")
    prefix = F.col("n") - _need(F.col("n"), percent) + 1 - own
    rare = ranked.where(prefix > 0).select(
        "sid", "n", own.alias("own"), F.posexplode(F.slice("by_rarity", F.lit(1), prefix.cast("int"))).alias("at", "e")
    )
    return rare.select("e.region", "sid", "n", "own", (F.col("own") + F.col("at")).alias("place"))


def _may_link(percent: int) -> Column:
    """Whether a point and a pivot (``p_`` columns) can link, judged in the region of their first common shingle.

    The sizes must fit, and from their places on both sets must hold enough shingles for the overlap a link needs.
    A pair that fails this in a later region has been judged in an earlier one.
    """
    overlap = F.ceil(percent * (F.col("n") + F.col("p_n")) / F.lit(100.0 + percent))
    left = F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place"))
    return (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")) & (left >= overlap)


def link_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``sets(sid, shingles)``, distinct sets, to ``sid, label``: one label per component of links.

    Sets that link with nothing may be missing.
    """
    r = 1 - percent / 100
    regions = written(_regions(sets, percent), "regions")
    # The point with the fewest shingles of its own is the best guess at a group's centre.
    firsts = (
        regions.groupBy("region")
        .agg(F.min(F.struct("own", "sid", "n", "place")).alias("p"), F.count(F.lit(1)).alias("points"))
        .where("points > 1")
        .select("region", F.col("p.sid").alias("p_sid"), F.col("p.n").alias("p_n"), F.col("p.place").alias("p_place"))
    )
    # Written, here and below, so that a join by region has an exchange of its own, whose large partitions Spark splits.
    firsts = written(firsts, "pivots")
    members = written(regions.join(firsts, "region").where("sid != p_sid"), "regions")
    pairs = members.where(_may_link(percent)).select(F.col("p_sid").alias("a"), F.col("sid").alias("b")).distinct()
    known = written(_verified(pairs, sets, percent), "distances")
    links = known.where("linked").select("a", "b")
    labels = components(links)

    # What is left of each region after its first pivot; d is null where the pair was ruled out unmeasured.
    near = written(members.join(known.select(F.col("a").alias("p_sid"), F.col("b").alias("sid"), "d", "linked"), ["p_sid", "sid"], "left"), "regions")
    far = ~F.coalesce("linked", F.lit(False))
    beyond = written(near.where(far).groupBy("region").agg(F.min(F.coalesce("d", F.lit(0.0))).alias("beyond")), "pivots")
    left = near.join(beyond, "region").where(far | (F.col("d") >= F.col("beyond") - r - 1e-9))
    region = left.select("region", "sid", "n", "place", "d")
    rounds = 0
    while True:
        rounds += 1
        labelled = region.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
        labelled = written(labelled.withColumn("label", F.coalesce("label", "sid")), "regions")
        by_label = labelled.groupBy("region", "label").agg(F.count(F.lit(1)).alias("c"))
        mixed = (
            by_label.groupBy("region")
            .agg(F.max(F.struct("c", "label")).alias("home"), F.sum("c").alias("points"))
            .where("points > home.c")
            .select("region", F.col("home.label").alias("home"), (F.col("points") - F.col("home.c")).alias("outside"))
        )
        mixed = written(mixed, "pivots")
        # Points of the largest component need not meet each other, so the others are the pivots.
        chosen = (F.col("label") != F.col("home")) & (
            (F.col("outside") <= SMALL_REGION) | (F.pmod(F.xxhash64("sid", F.lit(rounds)), F.lit(2)) == 0)
        )
        region = written(labelled.join(mixed, "region").withColumn("pivot", chosen).drop("home", "outside"), "regions")
        if region.isEmpty():
            return labels
        pivots = region.where("pivot").select("region", *[F.col(name).alias(f"p_{name}") for name in ("sid", "n", "place", "d", "label")])
        meeting = (
            (F.col("label") != F.col("p_label"))
            & (~F.col("pivot") | (F.col("sid") < F.col("p_sid")))
            & _may_link(percent)
            & (F.abs(F.coalesce(F.col("d") - F.col("p_d"), F.lit(0.0))) <= r + 1e-9)
        )
        met = region.join(pivots, "region").where(meeting)
        pairs = met.select(F.least("sid", "p_sid").alias("a"), F.greatest("sid", "p_sid").alias("b")).distinct()
        found = written(_verified(pairs, sets, percent).where("linked").select("a", "b"), "links")
        if not found.isEmpty():
            links = written(links.unionByName(found), "links")
            labels = components(links)
        region = region.where("NOT pivot").select("region", "sid", "n", "place", "d")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(column(docs, text), F.lit(""))
    return docs.select(column(docs, doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))


def _crowded(keyed: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """``sid, c_id, c_key`` of the sets that may have a link, by their unique shingles in the first share.

    Written in a function of its own: once nothing refers to the count's plan, Spark frees its shuffle files.
    """
    owners = _sampled(keyed, n).groupBy("shingle").agg(F.min("set_key").alias("set_key"), F.max("set_key").alias("other"))
    unique = owners.where("set_key = other").groupBy("set_key").agg(F.count(F.lit(1)).alias("unique"))
    # Two sets with one 64-bit key would be counted as one owner: both go on.
    keys = sets.groupBy("set_key").agg(F.count(F.lit(1)).alias("sets"))
    spare = F.col("n") - _need(F.col("n"), percent)
    counted = sets.join(unique, "set_key", "left").join(keys, "set_key")
    open_sets = counted.where((F.coalesce("unique", F.lit(0)) <= spare) | (F.col("sets") > 1))
    return written(open_sets.select("sid", F.col("first.doc_id").alias("c_id"), F.col("first.text_key").alias("c_key")), "crowded")


def jaccard_join(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_key, n_shingles, component_id``; ``text_key`` is ``xxhash64`` of the text.

    ``component_id`` is the smallest id reachable over links, the row's own included. A text without words, or a
    null, has an empty set, links with nothing and keeps its own id. Repeated rows are all returned. Null ids
    take part, but name no component unless all its ids are null.
    """
    keyed = _keyed(docs, text, doc_id)
    points = written(_points(keyed, n), "points")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = written(
        points.where("n > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("smallest"), F.min(rank).alias("first"), F.max("n").alias("n"), F.max("set_key").alias("set_key"))
        .withColumn("sid", F.monotonically_increasing_id()),
        "sets",
    )
    crowded = _crowded(keyed, sets, n, percent)
    small = broadcast_if_small(crowded, 200_000)
    texts = keyed.join(small, (F.col("text_key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")))
    whole = written(_sets(texts.select("sid", "text"), n).dropDuplicates(["sid"]), "crowded-sets")
    labels = link_components(whole, percent)
    named = sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    # Written, so that the join by label has an exchange of its own, whose large partitions Spark splits.
    lowest = written(named.groupBy("label").agg(F.min("smallest").alias("component_id")), "lowest")
    by_set = named.join(lowest, "label").select("digest", "component_id")
    none = points.where("n = 0").withColumn("component_id", F.col("doc_id"))
    out = points.where("n > 0").join(by_set, "digest").unionByName(none.select("digest", *points.drop("digest").columns, "component_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the document of the smallest id of every component, and all without words; columns as they were.

    Rows that share id *and* text are one document here; exact dedup is what removes them.
    """
    joined = written(jaccard_join(docs, n, percent, text, doc_id), "near-copies")
    dropped = joined.where((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = written(dropped.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")), "dropped")
    body = F.xxhash64(F.coalesce(column(docs, text), F.lit("")))
    rows = docs.select(F.struct(*[column(docs, name) for name in docs.columns]).alias("row"), column(docs, doc_id).cast("long").alias("k_id"), body.alias("k_key"))
    same = F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_key") == F.col("g_key"))
    return rows.join(broadcast_if_small(gone, 200_000), same, "left_anti").select("row.*")
