"""Phrases against a plain twin, with one range and with many."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from callharmony.llm import phrases
from callharmony.llm.automata import JOINT, Counter as Automaton
from callharmony.llm.phrases import collocations, frequent_phrases
from callharmony.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, least, top):
    seen, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for size in range(1, min(5, len(words) - i) + 1):
                    seen[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in seen.items():
        found, n = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, totals[lang]
        inside = set()
        for long, a in found.items():
            for i in range(len(long)):
                for j in range(i + 2, len(long) + 1):
                    if j - i < len(long) and long[i:j] in found and 100 * a >= 100 * found[long[i:j]]:
                        inside.add(long[i:j])
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def drawn(seed, count):
    random.seed(seed)
    words = ["a", "b", "Ab", "ab", "É", "é", "日本", "c\x1cd", "x" * 30, " ", "the", "of"]
    docs = []
    for _ in range(count):
        parts = random.choices(words, weights=range(1, len(words) + 1), k=random.randint(0, 60))
        joins = random.choices([" ", "\t", "  ", ". ", ",", "\n", "\r", "\v"], weights=[30, 3, 2, 2, 1, 1, 1, 1], k=len(parts))
        docs.append((random.choice(["en", "en", "de", None, "und", "", "e n"]), "".join(x for pair in zip(parts, joins, strict=True) for x in pair)))
    return docs + [("en", None), (None, None), ("en", "..."), ("zz", "one"), ("en", "the of " * 500)]


@pytest.mark.parametrize(("range_paths", "shard_words", "cut"), [(10**6, 10**6, 10**6), (300, 1000, 7), (40, 10**6, 10**6)])
def test_like_a_plain_twin(spark, monkeypatch, range_paths, shard_words, cut):
    monkeypatch.setattr(phrases, "RANGE_PATHS", range_paths)
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(phrases, "SLICE", cut)
    docs = drawn(5, 400)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = collocations(df, least=6, top=40)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(docs, 6, 40)


def test_many_ranges_over_a_given_table(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_PATHS", 5_000)
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op11_phrase_collocations"](spark, sf_dir)
    assert got.count() > 50
    assert oracle.difference(got, oracle.connect(sf_dir), ORACLES["op11_phrase_collocations"]) == ""


def test_counts_beyond_64_bits(spark):
    """1000 * a * n passes 2**63 here."""
    huge = 4_000_000_000
    rows = [("en", "", 0, huge * huge // 10**6, [], True), ("en", "a", 1, huge, [], False), ("en", "b", 1, huge - 1, [], False), ("en", "a b", 2, huge - 7, [huge], False)]
    table = spark.createDataFrame(rows, "lang string, phrase string, size int, f long, lefts array<long>, is_open boolean")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrases, "frequent_phrases", lambda *_: table)
        row = collocations(table).first()
    assert row["score"] == 1000 * (huge - 7) * (huge * huge // 10**6) // (huge * (huge - 1))


def test_odd_tables(spark, odd, empty):
    assert collocations(empty).collect() == []
    assert frequent_phrases(empty).where("size > 0").collect() == []
    given = [(row["lang"], row["text"]) for row in odd.collect()]
    assert sorted(map(tuple, collocations(odd, least=2).collect())) == plain(given, 2, 2000)


def test_automata():
    random.seed(6)
    words = sorted({bytes(random.choices(b"abc", k=random.randint(1, 3))) for _ in range(30)})
    paths = [[random.randint(1, len(words)) for _ in range(random.randint(1, 4))] for _ in range(3000)]
    matrix = np.array([path + [0] * (4 - len(path)) for path in paths], np.uint32)
    whole = Automaton.of(words, matrix)
    assert Counter(map(tuple, matrix.tolist())) == {tuple(p): w for p, w in zip(whole.paths.tolist(), whole.weights.tolist(), strict=True)}
    assert whole.paths.tolist() == sorted(whole.paths.tolist())

    parts = [Automaton.unpack(Automaton.of(words, matrix[i::3]).pack()) for i in range(3)]
    for most in (10, 10**6):
        united = Automaton.union(iter(parts), most)
        assert united.words == words and (united.paths == whole.paths).all() and (united.weights == whole.weights).all()

    for depth in range(1, 5):
        starts, sums = whole.states(depth)
        begins = Counter(tuple(path[:depth]) for path in paths if len(path) >= depth)
        assert {tuple(whole.paths[i, :depth].tolist()): w for i, w in zip(starts, sums, strict=True)} == begins

    bounds = sorted([[b"a"], [b"ab", b"b"], [b"abz"], [b"b", b"0"], [b"b", b"cc", b"a", b"a"], [b"zzz"]])
    split = dict(whole.split([JOINT.join(bound) for bound in bounds]))
    for number, part in split.items():
        for path in part.paths.tolist():
            spelled = [words[i - 1] for i in path if i]
            assert sum(bound <= spelled for bound in bounds) == number
    assert sum(len(part.paths) for part in split.values()) == len(whole.paths)
