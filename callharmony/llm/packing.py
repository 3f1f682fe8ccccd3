"""Best-fit packing with certified bin counts, and repacking across partitions where a gap is left.

Texts become token ids and are cut into pieces of at most one sequence. Pieces are dealt into partitions of
bounded size, each packed by best-fit decreasing. Dual-feasible functions give a lower bound on the number of
sequences any packing needs, from the histogram of all lengths. While the total lies above the bound, the pieces in
unfilled sequences leave their partitions, meet those of others and are packed again; a partition's new packing is
taken only if it needs fewer sequences than the old ones together. Partitions that meet a bound of their own take part
too: such bounds round up once per partition. A gap to the bound may be left when one partition holds all open
sequences, after a later round without gain, or after ``MAX_ROUNDS`` more.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from callharmony.llm.tables import column, written
from callharmony.llm.tokenizing import ID, WORD_BPE, encoder

CAPACITY = 2048
# Pieces dealt to a partition at first, and the most that meet in one when partitions are merged.
PART_PIECES, MOST_PIECES = 8_192, 65_536
MAX_ROUNDS = 4

PIECES = "piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Packed:
    """Placed pieces, how many sequences they take, and the fewest that any packing takes."""

    pieces: DataFrame
    sequences: int
    lower_bound: int
    rounds: int


def cut(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``doc_id`` and ``PIECES``. A null text is an empty one, so every row has a piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, np.array([end_id], ID).tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), capacity * ID.itemsize)):
                    part = ids[at : at + capacity * ID.itemsize]
                    rows.append((doc, piece, at // ID.itemsize, len(part) // ID.itemsize, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.mapInArrow(pieces, f"doc_id long, {PIECES}")


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs; ``histogram[n]`` pieces have length ``n``.

    The largest bound that two families of dual-feasible functions give: thresholds, which round pieces above
    ``capacity - e`` up and those below ``e`` down to nothing, and roundings to multiples of a ``k``-th.
    """
    sizes = np.arange(capacity + 1)
    best = -(-int((histogram * sizes).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):
        value = int(histogram[capacity - e + 1 :].sum()) * capacity + int((histogram * sizes)[e : capacity - e + 1].sum())
        best = max(best, -(-value // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        # Both times k * capacity, to stay with whole numbers.
        rounded = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((histogram * rounded).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece: the longest first, each into the fullest bin that still takes it."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # the bits of rooms say which lists are not empty
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[i]
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen, count = capacity, count, count + 1
        bins[i], offsets[i] = chosen, capacity - room
        if room > length:
            by_room[room - length].append(chosen)
            rooms |= 1 << (room - length)
    return bins, offsets


def repack(part: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One partition's pieces ``uid, length, sequence_id, offset, filled`` in a new packing, or the old one if no worse."""
    part = part.sort_values("uid", ignore_index=True)
    bins, offsets = best_fit_decreasing(part["length"].tolist(), capacity)
    if not part["sequence_id"].isna().any() and part["sequence_id"].nunique() <= max(bins) + 1:
        return part
    out = part.assign(bin=bins, offset=offsets)
    by_bin = out.groupby("bin")
    out["sequence_id"], out["filled"] = by_bin["uid"].transform("min"), by_bin["length"].transform("sum")
    return out.drop(columns="bin")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> Packed:
    """Place ``pieces(uid, length)``, uids being distinct: adds ``sequence_id`` and ``offset``.

    A sequence is named after the smallest uid in it. No pieces give no sequences.
    """
    counts = pieces.groupBy("length").count().collect()  # at most one row per length up to the capacity
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts:
        histogram[row["length"]] = row["count"]
    bound, full, loose = lower_bound(histogram, capacity), int(histogram[capacity]), int(histogram[:capacity].sum())
    parts = max(1, math.ceil(loose / PART_PIECES))
    schema = "uid long, length long, part long, sequence_id long, offset long, filled long"
    none = [F.lit(None).cast("long").alias(name) for name in ("sequence_id", "offset", "filled")]
    dealt = pieces.where(F.col("length") < capacity).select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part"), *none)
    done = [pieces.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    settled, total, rounds = full, full, 0
    while loose:
        before, rounds = total, rounds + 1
        state = written(dealt.groupBy("part").applyInPandas(lambda part: repack(part, capacity)[[f.split()[0] for f in schema.split(", ")]], schema), "packing")
        is_open = F.col("filled") < capacity
        row = state.agg(
            F.sum((F.col("offset") == 0).cast("long")).alias("bins"),
            F.sum((is_open & (F.col("offset") == 0)).cast("long")).alias("open_bins"),
            F.sum(is_open.cast("long")).alias("open"),
        ).first()
        total, open_pieces = settled + row["bins"], row["open"]
        last = total == bound or parts == 1 or rounds > MAX_ROUNDS or (rounds > 1 and total == before)
        placed = state if last else state.where(~is_open)
        done.append(placed.select("uid", "sequence_id", "offset"))
        if last:
            break
        settled += row["bins"] - row["open_bins"]
        # Whole partitions merge, so that a packing of theirs can be compared with the old ones.
        fan = max(2, min(parts, MOST_PIECES // max(1, open_pieces // parts)))
        parts = math.ceil(parts / fan)
        dealt = state.where(is_open).withColumn("part", F.floor(F.col("part") / fan).cast("long"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return Packed(pieces.join(placed, "uid"), total, bound, rounds)


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> Packed:
    """Tokenize, cut and pack every row of ``docs``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null ids and repeated rows are packed like all others; other columns play no part.
    """
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    pieces = written(cut(rows, tokenizer, end_id, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    packed = place(pieces, capacity)
    return Packed(packed.pieces.drop("uid"), packed.sequences, packed.lower_bound, packed.rounds)
