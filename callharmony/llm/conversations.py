"""Conversation structure repair: faults, and the cheapest edits that give a legal order of roles.

Rows are dealt by ranges of conversation and turn, so a conversation of any length is spread over tasks in order. A
conversation that lies whole within a task, and is not long, is repaired there. Of the others each task keeps chunks
of rows, with the best path through a chunk for every pair of grammar states; these paths are joined per conversation,
and the texts then stream once past the edits to be hashed. A conversation's audit is one value, so joining its paths
takes a few bytes a row in one task; its texts are never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from callharmony.llm import lattice
from callharmony.llm.tables import column, written

# A conversation with more rows or characters is handled in chunks of at most so many.
CHUNK_ROWS, CHUNK_CHARS = 2048, 4_000_000

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_WHITE = " \t\n\v\f\r"
# The order of rows. A row that repeats an earlier one is marked by a row of its own, which comes right before it.
_ORDER = ["conv_id", "turn", "role", "text_hash", "uid"]
_NAMES = {"s": "system", "u": "user", "a": "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with the faults the task asks for, by a hash of conversation and turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")])
    drawn = rows.select(
        "conv_id",
        "turn",
        *[F.coalesce(F.col(name), F.lit(" ")).alias(name) for name in ("role", "text")],
        (F.crc32(key) % 20).alias("fault"),
    ).where("fault != 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def letter_of(role: str, text: str, again: bool) -> tuple[str, str | None]:
    """A row for the lattice, and its first fault."""
    kept = text.rstrip(_WHITE)
    if not kept:
        return "x", "blank"
    if again:
        return "x", "duplicate"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (letter.upper(), "truncated") if kept[-1] not in ".!?" else (letter, None)


class Run:
    """Neighbouring rows of one conversation: counts, letters, and the rows themselves until they are taken away."""

    def __init__(self, conv):
        self.conv, self.letters, self.roles, self.texts, self.chars = conv, [], [], [], 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = 0
        self.low = self.high = self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        letter, fault = letter_of(role, text, again)
        if fault:
            self.faults[fault] += 1
        if self.letters:
            self.illegal += illegal(self.last_role, role[:1])
        else:
            self.first_role = role[:1]
        self.last_role = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.letters.append(letter)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)


def illegal(before: str, after: str) -> int:
    return (before + after) not in ("su", "ua", "au")


class Repaired:
    """Hashes the repaired rows of a conversation as they pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines = audit, 0, lattice.START, 0
        self.hash = hashlib.sha256()

    def _put(self, letter: str | None, role: str | None, text: str) -> None:
        if letter is None:  # the role the grammar asks for
            letter = "a" if self.state == lattice.USER else "u"
            role = _NAMES[letter]
        self.state = lattice.NEXT[self.state, letter]
        self.hash.update(f"{chr(10) * bool(self.lines)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(None, None, "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role[:1], role, text)
        elif edit == "R":
            self._put(None, None, text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def _schemas(conv_type) -> tuple[StructType, StructType]:
    """Of results, and of the chunks beside them."""
    texts = [StructField(name, StringType()) for name in ("audit", "repaired_sha256")]
    result = StructType([StructField("conv_id", conv_type), *[StructField(name, LongType()) for name in COUNTS], *texts])
    found = StructType.fromDDL(
        "part long, seq long, turns long, low long, high long, first_role string, last_role string,"
        " paths array<struct<enter: int, leave: int, cost: long, audit: string>>, roles array<string>, texts array<string>"
    )
    return result, StructType([*result.fields, *found.fields])


def _batch(rows: list[dict], schema: StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def _whole(run: Run) -> dict:
    cost, audit = lattice.cheapest("".join(run.letters))
    repaired = Repaired(audit)
    for role, text in zip(run.roles, run.texts, strict=True):
        repaired.add(role, text)
    gaps = 0 if run.low is None else run.high - run.low + 1 - run.turns
    return {"conv_id": run.conv, "gaps": gaps, **run.faults, "illegal": run.illegal, "cost": cost, "audit": audit, "repaired_sha256": repaired.digest()}


def _chunk(run: Run, part: int, seq: int) -> dict:
    paths = [{"enter": ends[0], "leave": ends[1], "cost": p[0], "audit": p[1]} for ends, p in lattice.paths("".join(run.letters)).items()]
    shared = {name: getattr(run, name) for name in ("illegal", "turns", "low", "high", "first_role", "last_role", "roles", "texts")}
    return {"conv_id": run.conv, "part": part, "seq": seq, **run.faults, **shared, "paths": paths}


def _repair_sorted(batches: Iterator[pa.RecordBatch], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Whole conversations as results (``part`` is null), the others as chunks; rows come in order."""
    part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
    run, opened, again = None, True, False  # the first conversation may have begun in an earlier task

    def finish(is_open: bool) -> Iterator[pa.RecordBatch]:
        nonlocal seq, held, out
        out.append(_chunk(run, part, seq) if is_open else _whole(run))
        seq += 1
        held += run.chars if is_open else 0
        if len(out) >= 512 or held >= CHUNK_CHARS:
            yield _batch(out, schema)
            out, held = [], 0

    for batch in batches:
        names = ("conv_id", "turn", "role", "text", "mark")
        for conv, turn, role, text, mark in zip(*[batch[name].to_pylist() for name in names], strict=True):
            if mark:
                again = True
                continue
            if run is None:
                run = Run(conv)
            elif run.conv != conv:
                yield from finish(opened)
                run, opened = Run(conv), False
            elif len(run.letters) >= CHUNK_ROWS or run.chars >= CHUNK_CHARS:
                yield from finish(True)
                run, opened = Run(conv), True
            run.add(turn, role, text, again)
            again = False
    if run is not None:
        yield from finish(True)  # it may go on in the next task
    if out:
        yield _batch(out, schema)


def _plan(chunks: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """The counts and the audit of one conversation from its chunks."""
    chunks = chunks.sort_values(["part", "seq"], ignore_index=True)
    total = {name: int(chunks[name].sum()) for name in ("blank", "duplicate", "truncated", "illegal")}
    turns, low, high, role = 0, None, None, None
    for chunk in chunks.itertuples():
        if role is not None:
            total["illegal"] += illegal(role, chunk.first_role)
        role = chunk.last_role
        if not pd.isna(chunk.low):
            turns += int(chunk.turns) - (high == chunk.low)
            low, high = chunk.low if low is None else low, chunk.high
    paths = [{(p["enter"], p["leave"]): (p["cost"], p["audit"]) for p in found} for found in chunks["paths"]]
    cost, audit = lattice.best_of(lattice.join_all(paths))
    gaps = 0 if low is None else int(high) - int(low) + 1 - turns
    row = {"conv_id": chunks["conv_id"][0], "gaps": gaps, **total, "cost": cost, "audit": audit, "repaired_sha256": None}
    return pd.DataFrame([row], columns=columns)


def _hash_sorted(batches: Iterator[pa.RecordBatch], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Plans with their hash filled in; each is followed by its conversation's chunks in order."""
    plan, repaired, out = None, None, []
    names = schema.names
    for batch in batches:
        for row in range(batch.num_rows):
            values = {name: batch[name][row].as_py() for name in [*names, "part", "roles", "texts"]}
            if values["part"] < 0:
                if plan is not None:
                    out.append({**plan, "repaired_sha256": repaired.digest()})
                plan, repaired = {name: values[name] for name in names}, Repaired(values["audit"])
            else:
                for role, text in zip(values["roles"], values["texts"], strict=True):
                    repaired.add(role, text)
    if plan is not None:
        out.append({**plan, "repaired_sha256": repaired.digest()})
    if out:
        yield _batch(out, schema)


def repair_conversations(
    rows: DataFrame,
    ids: DataFrame | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Per conversation of ``rows``: ``conv_id``, ``COUNTS``, ``audit`` and ``repaired_sha256``.

    Rows are taken by turn, nulls first; rows of one turn by role and then by a hash of the text. A null role or text
    is one blank; rows with a null conversation are one conversation. ``ids(conv_id)`` names further conversations:
    those without rows have zeros, an empty audit and the hash of an empty text. An empty table gives no rows; other
    columns play no part.
    """
    blank = F.lit(" ")
    plain = rows.select(
        column(rows, conv_id).alias("conv_id"),
        column(rows, turn).cast("long").alias("turn"),
        F.coalesce(column(rows, role), blank).alias("role"),
        F.coalesce(column(rows, text), blank).alias("text"),
    )
    # The role's length keeps it apart from the text.
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = plain.withColumns({"text_hash": F.xxhash64("text"), "digest": digest, "uid": F.monotonically_increasing_id()})
    keyed = written(keyed, "turns")  # from here on a row's uid is fixed

    place = F.struct("turn", "role", "text_hash", "uid")
    firsts = keyed.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select(F.col("conv_id").alias("f_conv"), F.col("digest").alias("f_digest"), F.col("first.uid").alias("f_uid")), "first-turns")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("digest") == F.col("f_digest"))
    again = keyed.select(*_ORDER, "digest").join(firsts, same).where("uid != f_uid").select(*_ORDER)

    # Texts move once. The mark of a repeated row sorts right before it.
    dealt = keyed.select(*_ORDER, "text", F.lit(0).alias("mark")).unionByName(
        again.select(*_ORDER, F.lit(None).cast("string").alias("text"), F.lit(1).alias("mark"))
    )
    in_order = [F.col(name).asc_nulls_first() for name in _ORDER]
    dealt = dealt.repartitionByRange(*in_order).sortWithinPartitions(*in_order, F.col("mark").desc())
    result, found_type = _schemas(keyed.schema["conv_id"].dataType)
    found = dealt.mapInArrow(partial(_repair_sorted, schema=found_type), found_type)
    found = written(found, "repaired-turns")

    chunks = found.where("part IS NOT NULL")
    plans = chunks.drop("roles", "texts").groupBy("conv_id").applyInPandas(lambda some: _plan(some, result.names), result)
    plans = plans.withColumns({"part": F.lit(-1).cast("long"), "seq": F.lit(-1).cast("long"), "roles": F.array().cast("array<string>"), "texts": F.array().cast("array<string>")})
    stream = plans.unionByName(chunks.select(plans.columns)).repartition("conv_id")
    stream = stream.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")
    finished = stream.mapInArrow(partial(_hash_sorted, schema=result), result)
    repaired = found.where("part IS NULL").select(result.names).unionByName(finished)
    if ids is None:
        return repaired

    repaired = written(repaired, "repaired")
    known = repaired.select(F.col("conv_id").alias("k_id"))
    missing = ids.select(column(ids, conv_id).alias("conv_id")).distinct().join(known, F.col("conv_id").eqNullSafe(F.col("k_id")), "left_anti")
    nothing = {name: F.lit(0).cast("long") for name in COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return repaired.unionByName(missing.withColumns(nothing).select(result.names))
