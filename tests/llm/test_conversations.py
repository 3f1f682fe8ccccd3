"""Repair against a plain twin: rows in Python, edits by dynamic programming."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from callharmony.llm import conversations, lattice
from callharmony.llm.conversations import damage, repair_conversations
from callharmony.llm.queries import QUERIES

LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
NAMES = {"u": "user", "a": "assistant"}


def plain_edits(rows):
    """Least ``(cost, audit, repaired)``; ``rows`` are (role, text, must go, truncated). States are last initials."""

    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, done) in list(best.items()):
                for role in "ua":
                    if (last, role) in LEGAL:
                        put(best, role, (cost + 2, audit + "I", (*done, f"{NAMES[role]}:")))
        return best

    def put(best, last, path):
        if last not in best or path[:2] < best[last][:2]:
            best[last] = path

    best = inserted({"": (0, "", ())})
    for role, text, gone, short in rows:
        after = {}
        for last, (cost, audit, done) in best.items():
            put(after, last, (cost + 3, audit + "D", done))
            if gone:
                continue
            if role[:1] and (last, role[:1]) in LEGAL:
                put(after, role[:1], (cost + short, audit + "K", (*done, f"{role}:{text}")))
            for other in "ua":
                if (last, other) in LEGAL:
                    put(after, other, (cost + 2 + short, audit + "R", (*done, f"{NAMES[other]}:{text}")))
        best = inserted(after)
    return min((best[last] for last in ("", "a") if last in best), key=lambda path: path[:2])


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows, ids):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role, text))
    out = {}
    for conv in {*ids, *by_conv}:
        own = sorted(by_conv[conv], key=lambda row: (row[0] is not None, row[0] or 0))
        seen, judged, faults = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            first = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faults[first] = faults.get(first, 0) + 1
            judged.append((role, text, first in ("blank", "duplicate"), first == "truncated"))
        turns = [turn for turn, *_ in own if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, done = plain_edits(judged)
        digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], wrong, cost, audit, digest)
    return out


def as_dict(df):
    rows = df.collect()
    assert df.columns == ["conv_id", *conversations.COUNTS, "audit", "repaired_sha256"]
    found = {row[0]: tuple(row[1:]) for row in rows}
    assert len(found) == len(rows)
    return found


def drawn(seed, convs, size):
    """Rows whose order is settled by turn alone, but for equal ones."""
    random.seed(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in sorted(random.sample(range(2 * size), random.randint(1, size))):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "", "tool", "u", None])
            text = random.choice(["One.", "Two?", "Three", "", " \t\n", "Four. ", "é!", "x" * 40, None])
            rows.append((conv, turn, role, text))
    return rows + [(7, None, "user", "no turn"), (convs + 1, None, None, None)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "convs", "size"), [(1, 150, 8), (2, 3, 200)])
def test_like_a_plain_twin(spark, conf, monkeypatch, seed, convs, size):
    conf(spark__sql__shuffle__partitions="7", spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = drawn(seed, convs, size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain_repair(plain_damage(rows), {row[0] for row in rows})
    assert as_dict(repair_conversations(damage(df), df)) == want
    assert as_dict(repair_conversations(df)) == plain_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], [])


def test_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op13_conversation_repair"](spark, sf_dir)) == plain_repair(plain_damage(rows), {row[0] for row in rows})


def test_one_conversation_over_many_tasks_and_chunks(spark, conf):
    """A third of all rows has no conversation, and a third of those are equal."""
    conf(spark__sql__shuffle__partitions="16", spark__sql__adaptive__coalescePartitions__enabled="false")
    random.seed(3)
    rows = [(None, i, ("user", "assistant")[i % 2], f"Row {i}." if i % 3 else "Same.") for i in range(9_000)]
    rows += [(i // 4, i % 4, ("user", "assistant")[i % 2], f"Text {i}") for i in range(18_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(repair_conversations(df)) == plain_repair(rows, [])


def test_odd_tables(spark):
    rows = [(1, 1, "user", "Hi.", "k", 5), (1, 1, "user", "Hi.", "k", 5), (1, 2, "assistant", "Yes.", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, audit string, cost long")
    hashed = hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert as_dict(repair_conversations(df)) == {1: (0, 0, 1, 0, 1, 3, "KDK", hashed)}
    assert as_dict(repair_conversations(df.limit(0), df.limit(0))) == {}
    assert as_dict(repair_conversations(df.limit(0), df)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_lattice_like_plain_edits():
    def both(letters):
        rows = [({"s": "s", "u": "u", "a": "a", "o": "t", "x": "u"}[r.lower()], "", r == "x", r.isupper()) for r in letters]
        assert lattice.cheapest("".join(letters)) == plain_edits(rows)[:2], letters

    for size in range(4):
        for letters in itertools.product("suaoSUAOx", repeat=size):
            both(letters)
    random.seed(4)
    for _ in range(200):
        both(random.choices("suaoSUAOx", k=random.randint(10, 130)))
