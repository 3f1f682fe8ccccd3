"""Language identification by rank order: a document's most frequent n-grams against each language's.

A profile lists n-grams (one to three letters, words padded with a blank) from the most frequent on; equal counts
are ordered by the n-gram itself. The out-of-place distance between two profiles adds up how far each of the
document's n-grams stands from its place in the language's list, and the full length for one that is missing.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from callharmony.llm.tables import column

PROFILE = 400
UNKNOWN = "und"
SHIFT, BLANK = 21, 32  # bits of a code point; a blank

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a whole text as numbers; empty where it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4").astype(np.int64)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.concatenate([[BLANK], np.where(letter, codes, BLANK), [BLANK]])
    codes = codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]
    pairs = (codes[:-1] << SHIFT) | codes[1:]
    triples = ((pairs[:-1] << SHIFT) | codes[2:])[codes[1:-1] != BLANK]
    return np.concatenate([codes[codes != BLANK], pairs, triples])


def ranked(values: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, in order."""
    names, counts = np.unique(values, return_counts=True)
    return names[np.lexsort((names, -counts))[:size]]


def learn(docs: DataFrame, size: int = PROFILE, text: str = "text", lang: str = "lang") -> DataFrame:
    """Profiles ``lang, gram, place`` of the languages in ``docs``: at most ``size`` rows for each.

    Rows without a language and texts without letters teach nothing.
    """
    rows = docs.select(column(docs, lang).cast("string").alias("lang"), column(docs, text).alias("text")).where("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, found = batch.slice(at, 500), defaultdict(list)
                for name, body in zip(part["lang"].to_pylist(), part["text"], strict=True):
                    found[name].append(grams(body.as_py()))
                for name, arrays in found.items():
                    values, counts = np.unique(np.concatenate(arrays), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"]
                    )

    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return total.select("lang", "gram", place.alias("place")).where(F.col("place") <= size)


class Profiles:
    """All languages' places side by side: one row per n-gram, one column per language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({row[0] for row in rows})
        self.names = np.unique(np.array([row[1] for row in rows], np.int64))
        self.places = np.full((len(self.names) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        columns = {name: i for i, name in enumerate(self.langs)}
        for name, gram, place in rows:
            self.places[np.searchsorted(self.names, gram), columns[name]] = place - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first by name among equals, and 1 minus the share of the largest distance."""
        own = ranked(grams(text), self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.names, own)
        at[at == len(self.names)] = 0
        known = self.names[at] == own
        places = self.places[np.where(known, at, len(self.names))]
        apart = np.abs(places - np.arange(len(own))[:, None])
        distance = np.where(places < 0, self.size, apart).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the whole texts.

    A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing was learned.
    The profiles, ``size`` rows per language, go to all tasks. Columns of these two names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(row) for row in profiles.select("lang", "gram", "place").collect()], size))

    @F.arrow_udf("lang string, score double")
    def guess(texts: pa.Array) -> pa.Array:
        found = [known.value.predict(body.as_py()) for body in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"]
        )

    keep = [name for name in docs.columns if name.lower() not in ("lang_pred", "score")]
    guessed = docs.select(*[column(docs, name) for name in keep], guess(column(docs, text)).alias("lang_pred"))
    parts = F.col("lang_pred.lang").alias("lang_pred"), F.col("lang_pred.score").alias("score")
    return guessed.select(*[F.col(f"`{name}`") for name in keep], *parts)
