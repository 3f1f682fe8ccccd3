import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from callharmony.llm import packing, tokenizing
from callharmony.llm.tokenizing import WORD_BPE, Encoder

_LIBRARY, _ENCODER = Tokenizer.from_file(WORD_BPE), Encoder(WORD_BPE)


def optimum(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i]:
                place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0] if lengths else 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bound_optimum_and_packing_are_in_order(lengths):
    histogram = np.bincount(np.array(lengths, np.int64), minlength=21)
    bins, offsets = packing.best_fit_decreasing(lengths, 20)
    assert packing.lower_bound(histogram, 20) <= optimum(lengths, 20) <= len(set(bins))
    filled = defaultdict(list)
    for length, b, offset in zip(lengths, bins, offsets, strict=True):
        filled[b].append((offset, length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 20


def test_bounds_beyond_the_sum():
    histogram = np.zeros(2049, np.int64)
    histogram[1025] = 10
    assert packing.lower_bound(histogram, 2048) == 10
    histogram[:] = 0
    histogram[683] = 9  # three do not fit
    assert packing.lower_bound(histogram, 2048) == 5


def check_layout(rows):
    sequences = defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    return len(sequences)


def test_partitions_exchange_until_the_bound_is_met(spark, monkeypatch):
    pieces = spark.range(4000).selectExpr("id AS uid", "(id * 7919) % 2047 + 1 AS length")
    alone = packing.place(pieces)
    monkeypatch.setattr(packing, "PART_PIECES", 60)
    monkeypatch.setattr(packing, "MOST_PIECES", 400)
    packed = packing.place(pieces)
    rows = packed.pieces.collect()
    assert sorted(row["uid"] for row in rows) == list(range(4000))
    assert check_layout(rows) == packed.sequences
    assert packed.rounds > 1 and packed.lower_bound == alone.lower_bound
    assert packed.sequences <= 1.02 * packed.lower_bound


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = packing.pack(docs)
    rows = packed.pieces.collect()
    assert check_layout(rows) == packed.sequences >= packed.lower_bound
    library, pieces = Tokenizer.from_file(WORD_BPE), defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append(row)
    for doc in docs.collect():
        ids = np.array([*library.encode(doc["text"], add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(pieces[doc["doc_id"]], key=lambda row: row["piece"])
        assert [p["piece"] for p in parts] == list(range(-(-len(ids) // 2048)))
        for p in parts:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == 2048 * p["piece"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
        assert sum(p["length"] for p in parts) == len(ids)


def test_odd_rows(odd, empty):
    packed = packing.pack(odd)
    rows = packed.pieces.collect()
    assert check_layout(rows) == packed.sequences
    assert sum(row["piece"] == 0 for row in rows) == odd.count()
    assert [row["length"] for row in rows if row["doc_id"] == 3] == [1]
    none = packing.pack(empty)
    assert none.pieces.count() == 0 and none.sequences == none.lower_bound == 0


def test_ids_are_the_library_s():
    library, encoder = Tokenizer.from_file(WORD_BPE), Encoder(WORD_BPE)
    words = ["Don't", "WE'LL", "naïve", "été", "Σας", "İx", "a1b2", "x<|endoftext|>y", "<|startoftext|>", "--", "日本語", "😀!", "\x1cz", "\x85", " q", "'s", "A.", "(b)", "`c`", "ß"]
    for a, b in combinations_with_replacement(words, 2):
        for text in (f"{a} {b}", f"{a}\n\t{b}", a + b):
            want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert encoder.ids(text) == want, text


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aAzZ09 .,'’-_\"\n\t\v\x1c\x00\x85\xa0éÉßẞıİſÆΣςЖж日😀́ﬁ½²ªẞstreLD<|>"), max_size=20))
def test_ids_of_any_text(text):
    want = np.array(_LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert _ENCODER.ids(text) == want


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED", 20)
    small = Encoder(WORD_BPE)
    for i in range(300):
        text = " ".join(f"w{chr(97 + i % 26)}ord{chr(97 + j)}é {i}日{j}" for j in range(i % 40))
        assert small.ids(text) == _ENCODER.ids(text)
        assert len(small.units) + len(small.units.older) < 400 and not getattr(small.units.older, "older", None)


def test_a_tokenizer_that_minds_white_space_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), Encoder(path)
    for text in ("Two  words\n\n and", " x", "été's"):
        assert encoder.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
