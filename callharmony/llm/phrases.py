"""Phrase collocation mining with weighted acyclic automata.

1. Each task reads its texts in shards of bounded size. All word sequences of up to five words that begin at a place
   are one path, so a shard's automaton has the counts of all n-grams as the weights of its states.
2. Shards are cut at prefixes into ranges, and the parts of a range are united, their weights summed. Bounds between
   ranges come from a sample of the paths and only decide how even the ranges are.
3. States below the least count end here. Along the path of a frequent phrase stand the counts of all its first parts,
   so composing phrase and automaton gives them at once. Only the few states on a bound between ranges are known in
   parts, and are added up apart. The remaining part of a cut starts elsewhere and is looked up by a join, since every
   part of a frequent phrase is itself in the table of frequent phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from callharmony.llm.automata import JOINT, Counter
from callharmony.llm.tables import broadcast_if_small, column, written

# Fixed by the task.
WORDS, LEAST, TOP, SCALE, COVERED_PERCENT = 5, 100, 2000, 1000, 100
NO_LANG = "und"

# Words in a shard, characters of a text that are split at once, and the paths a range is meant to have.
SHARD_WORDS, SLICE, RANGE_PATHS = 1 << 20, 1 << 20, 1_000_000
# Bounds go to every task, some 70 MB at most. Beyond so many ranges (5 TB of text) ranges are larger instead.
MAX_RANGES = 1 << 20
SAMPLES_PER_RANGE, MAX_SAMPLES, SAMPLED_WORDS = 8, 1 << 21, 2_000
BYTES_PER_WORD = 5

BREAK = JOINT
_TABLE = bytearray(range(256))
for _i in range(26):
    _TABLE[65 + _i] = 97 + _i
for _c in b".,;:!?\n\v\f\r":
    _TABLE[_c] = 0xFF
_TABLE = bytes(_TABLE)
_BETWEEN = re.compile(rb"[ \t\xff]")


def tokens_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text and ``BREAK`` between its pieces, some at a time; the last one is a break."""
    body = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(body):
        end = len(body)
        if at + SLICE < end:
            found = _BETWEEN.search(body, at + SLICE)
            end = found.start() if found else end
        # Only blanks, tabs and breaks part words; every other white space was made a break.
        yield body[at:end].replace(BREAK, b" \xff ").split()
        at = end
    yield [BREAK]


class Numbers(dict):
    """Numbers words in the order in which they are first asked for; a break is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Shard:
    """Collects texts and gives their automaton; the first label of a path is the language."""

    def __init__(self, width: int = WORDS):
        self.width = width
        self._clear([], [])

    def _clear(self, words: list[bytes], langs: list[bytes]) -> None:
        self.known = Numbers({BREAK: 0})
        self.parts, self.langs, self.size = [], [], 0
        for lang, word in zip(langs, words, strict=True):
            self.add(lang, [word])

    def add(self, lang: bytes, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.known.__getitem__, tokens), np.uint32, len(tokens)))
        self.langs.append((self.known[lang], len(tokens)))
        self.size += len(tokens)

    def take(self, last: bool) -> Counter:
        """The automaton of what was collected. Unless it is the ``last``, words whose sequence may go on stay."""
        words = sorted(self.known.keys() - {BREAK})
        label = np.zeros(len(self.known), np.uint32)
        label[[self.known[word] for word in words]] = np.arange(1, len(words) + 1)
        numbers = label[np.concatenate([*self.parts, np.zeros(0, np.uint32)])]
        langs = label[np.repeat([lang for lang, _ in self.langs], [count for _, count in self.langs]).astype(np.int64)]
        stay = 0
        while not last and stay < min(self.width - 1, len(numbers)) and numbers[-1 - stay]:
            stay += 1
        padded = np.concatenate([numbers, np.zeros(self.width, np.uint32)])
        starts = np.flatnonzero(numbers[: len(numbers) - stay])
        paths = np.empty((len(starts), 1 + self.width), np.uint32)
        paths[:, 0], alive = langs[starts], np.ones(len(starts), bool)
        for i in range(self.width):
            alive &= padded[starts + i] > 0
            paths[:, 1 + i] = np.where(alive, padded[starts + i], 0)
        tail = slice(len(numbers) - stay, len(numbers))
        self._clear([words[i - 1] for i in numbers[tail].tolist()], [words[i - 1] for i in langs[tail].tolist()])
        return Counter.of(words, paths)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Counter]:
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            name = b"=" + lang.as_py().encode("utf-8", "surrogatepass")
            for tokens in tokens_of(text.as_py()):
                shard.add(name, tokens)
                if shard.size >= size:
                    yield shard.take(False)
    yield shard.take(True)


def _bounds(rows: DataFrame, ranges: int, words: float) -> list[bytes]:
    """Where ranges begin, from a sample of the documents; at most ``ranges - 1`` bounds."""
    if ranges < 2:
        return []
    wanted = min(SAMPLES_PER_RANGE * ranges, MAX_SAMPLES)
    # Some thousand words for each path that is drawn, so that no document decides alone.
    read = min(words, SAMPLED_WORDS * wanted)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = np.random.default_rng(1)
        for counter in _shards(batches, SHARD_WORDS):
            some = np.flatnonzero(drawn.random(len(counter.paths)) < wanted / read)
            paths = [JOINT.join([counter.words[i - 1] for i in counter.paths[row].tolist() if i]) for row in some]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary())], ["path"])

    sample = rows.sample(read / words, seed=1).mapInArrow(draw, "path binary").distinct()
    found = sorted((bytes(row[0]) for row in sample.collect()), key=lambda path: path.split(JOINT))
    return [found[i] for i in sorted({len(found) * i // ranges for i in range(1, ranges)}) if i < len(found)]


_FOUND = "lang string, phrase string, size int, f long, lefts array<long>, is_open boolean"


def _united(parts: Iterator[Counter], low: bytes | None, high: bytes | None, least: int) -> pd.DataFrame:
    """The frequent phrases of one range with the counts along their paths, and the states on its bounds.

    ``size`` 0 stands for all words of a language. A state on a bound has null for the counts on its path.
    """
    counter = Counter.union(parts)
    label = {word: i + 1 for i, word in enumerate(counter.words)}
    bounds = [[label.get(word, -1) for word in bound.split(JOINT)] for bound in (low, high) if bound]
    levels, out = [], []
    for depth in range(1, counter.paths.shape[1] + 1):
        starts, sums = counter.states(depth)
        is_open = np.full(len(starts), depth == 1)
        for bound in bounds:
            if len(bound) >= depth:
                is_open |= (counter.paths[starts, :depth] == bound[:depth]).all(axis=1)
        keep = is_open | (sums >= least)
        starts, sums, is_open = starts[keep], sums[keep], is_open[keep]
        # A state's paths stand together, so of each earlier level the last state that begins before is on the path.
        above = [np.searchsorted(level[0], starts, "right") - 1 for level in levels[1:]]
        lefts = [np.where(edge[at], -1, total[at]).tolist() for at, (_, total, edge) in zip(above, levels[1:], strict=True)]
        levels.append((starts, sums, is_open))
        for i, (start, total, edge) in enumerate(zip(starts.tolist(), sums.tolist(), is_open.tolist(), strict=True)):
            path = [counter.words[label - 1] for label in counter.paths[start, :depth].tolist()]
            phrase = b" ".join(path[1:]).decode("utf-8", "surrogatepass")
            known = [None if left[i] < 0 else left[i] for left in lefts]
            out.append((path[0][1:].decode("utf-8", "surrogatepass"), phrase, depth - 1, total, known, edge))
    return pd.DataFrame(out, columns=["lang", "phrase", "size", "f", "lefts", "is_open"])


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, size, f, lefts, is_open`` of all sequences of up to five words with ``f >= least``.

    ``size`` 0 has the number of all words of a language. ``lefts`` are the counts of the phrase's first 1, 2, ...
    words; null where these are on a bound between ranges, which ``is_open`` marks.
    """
    rows = docs.select(F.coalesce(column(docs, lang).cast("string"), F.lit(NO_LANG)).alias("lang"), column(docs, text).alias("text"))
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BYTES_PER_WORD + 1
    bounds = _bounds(rows, min(MAX_RANGES, int(words // RANGE_PATHS) + 1), words)

    range_schema = pa.schema([("range", pa.int32()), ("packed", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counter in _shards(batches, SHARD_WORDS):
            for number, part in counter.split(bounds):
                yield pa.RecordBatch.from_pylist([{"range": number, "packed": part.pack()}], range_schema)

    def unite(parts: pd.DataFrame) -> pd.DataFrame:
        number = int(parts["range"].iloc[0])
        low, high = (bounds[i] if 0 <= i < len(bounds) else None for i in (number - 1, number))
        return _united(map(Counter.unpack, parts["packed"]), low, high, least)

    found = written(rows.mapInArrow(count, "range int, packed binary").groupBy("range").applyInPandas(unite, _FOUND), "phrases")
    added = found.where("is_open").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))
    none = F.transform(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1))), lambda i: F.lit(None).cast("long"))
    return written(found.where("NOT is_open").unionByName(added.withColumns({"lefts": none, "is_open": F.lit(True)})), "frequent-phrases")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, covered_percent: int = COVERED_PERCENT, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A null language is ``und``, a null text empty. Phrases of equal score are ordered by count, then by their bytes.
    Repeated rows count as often as they stand; an empty table, and one without frequent phrases, gives no rows.
    Ids and other columns play no part. All arithmetic is on whole numbers of up to 38 digits.
    """
    phrases = frequent_phrases(docs, least, text, lang)
    totals = phrases.where("size = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    counted = phrases.where("size > 0").select("lang", "phrase", "size", F.col("f").alias("a"), "lefts")
    candidates = counted.where("size > 1")
    parts = counted.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("part"), F.col("a").alias("count"))

    words = candidates.withColumn("words", F.split("phrase", " "))
    cuts = words.select("lang", "phrase", "size", "a", "words", "lefts", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
        F.get("lefts", F.col("k") - 1).alias("path_l"),
    )
    # At most five states a bound.
    opened = phrases.where("is_open AND size > 0")
    opened = broadcast_if_small(opened.select(F.col("lang").alias("o_lang"), F.col("phrase").alias("o_phrase"), F.col("f").alias("open_l")))
    lefts = cuts.join(opened, (F.col("lang") == F.col("o_lang")) & (F.col("first") == F.col("o_phrase")), "left")
    both = lefts.join(parts, (F.col("lang") == F.col("p_lang")) & (F.col("rest") == F.col("part")))
    both = both.join(broadcast_if_small(totals), F.col("lang") == F.col("n_lang"))
    both = both.select("lang", "phrase", "a", "k", F.coalesce("path_l", "open_l").alias("l"), F.col("count").alias("r"), "n")
    score = F.expr(f"CAST((CAST({SCALE} * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) AS DECIMAL(38, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))

    inner = words.where("size > 2").select("lang", "words", "size", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("width"))
    inner = inner.select("lang", "words", "a", "width", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)).alias("at"))
    inner = inner.select(F.col("lang").alias("c_lang"), F.array_join(F.slice("words", F.col("at"), F.col("width")), " ").alias("inside"), "a")
    covering = inner.groupBy("c_lang", "inside").agg(F.max("a").alias("longer"))
    covered = (F.col("lang") == F.col("c_lang")) & (F.col("phrase") == F.col("inside")) & (100 * F.col("longer") >= covered_percent * F.col("a"))
    left = best.join(covering, covered, "left_anti").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
