"""Quality rules with thresholds that adapt to each language and source.

Every document gets rates (symbols, doubled lines and words, capitals, exclamation marks, word length). Their quantiles are
kept as mergeable KLL sketches per language and source. A group's fence is its third quartile plus a multiple of
its interquartile range. It is blended with that of the merged sketch of its language, and this with that of
everything, each weighed by its number of documents, so that no number of documents switches from one to another. The
fences are then joined to the documents, and those outside are rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from callharmony.llm.tables import broadcast_if_small, column, written
from callharmony.llm.words import numbered, window_ids, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_doubled"]
COUNTS_TYPE = StructType([StructField(name, LongType(), False) for name in COUNTS])

# Fixed by the task: the least number of words, and the largest share of repeated words in per cent.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

# Rates a fence is set on, with the least distance from the median that is ever rejected: a group whose
# documents are all alike still accepts a document that differs by less.
UPPER = {"symbol_rate": 0.10, "dup_line_rate": 0.30, "upper_rate": 1.00, "mark_rate": 0.25, "doubled_rate": 0.15, "long_rate": 2.5}
LOWER = {"long_rate": 2.0}
SPREAD = 4.0
# With so many documents a group's own fence weighs as much as that of its language, and that as that of everything.
BLEND = 5
# Word length says nothing from one language to the next: its fences are not blended with those of everything.
OWN = ("long_rate",)
# How much farther from the median a fence stands for a language with one document; with the root of their number less.
WIDER = 2.0
SKETCH_K = 400

# What parts words.
WHITE = " \t\n\v\f\r"
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def counts_of(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one whole text; zeros for a null."""
    text = text or ""
    words = words_of(text)
    lines, doubled, filled = set(), 0, 0
    for line in text.split("\n"):
        if words_of(line):
            filled += 1
            doubled += line in lines
            lines.add(line)
    numbers = numbered(words)
    windows = window_ids(numbers, WINDOW)
    covered = 0
    if len(windows):
        again = np.bincount(windows)[windows] > 1
        steps = np.zeros(len(words) + 1, np.int64)
        starts = np.flatnonzero(again)
        steps[starts] += 1
        np.subtract.at(steps, starts + WINDOW, 1)
        covered = int((np.cumsum(steps[:-1]) > 0).sum())
    chars = len(text) - sum(map(text.count, WHITE))
    return (len(words), chars, len(_SYMBOLS.findall(text)), doubled, covered, filled, len(_UPPER.findall(text)), text.count("!"), int((numbers[1:] == numbers[:-1]).sum()))


@F.arrow_udf(COUNTS_TYPE)
def text_counts(texts: pa.Array) -> pa.Array:
    rows = np.array([counts_of(text.as_py()) for text in texts], np.int64).reshape(len(texts), len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=COUNTS)


# So marked, it is not computed again for a filter that Spark would move below a join.
text_counts = text_counts.asNondeterministic()


def _rates(counts: str) -> dict[str, Column]:
    c = {name: F.col(f"`{counts}`.`{name}`").cast("double") for name in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1.0))
    return {
        "symbol_rate": c["n_symbols"] / words,
        "dup_line_rate": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
        "upper_rate": c["n_upper"] / words,
        "mark_rate": c["n_marks"] / words,
        "doubled_rate": c["n_doubled"] / words,
        "long_rate": c["word_chars"] / words,
    }


def _group(df: DataFrame, name: str) -> Column:
    """A group key without nulls: null is a group of its own, apart from every text."""
    return F.coalesce(F.concat(F.lit("="), column(df, name).cast("string")), F.lit("null"))


def base_failed(counts: str) -> Column:
    c = F.col(f"`{counts}`")
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def fences(counted: DataFrame, counts: str, lang: str, source: str) -> DataFrame:
    """One row per language and source: ``lang_key, source_key, low_<rate>, high_<rate>``.

    Documents that fail the base rules do not shape the fences. A group without other documents has no row.
    """
    rates = _rates(counts)
    kept = counted.where(~base_failed(counts)).select(
        _group(counted, lang).alias("lang_key"),
        _group(counted, source).alias("source_key"),
        *[value.alias(name) for name, value in rates.items()],
    )
    fine = written(
        kept.groupBy("lang_key", "source_key").agg(
            F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(name, F.lit(SKETCH_K)).alias(name) for name in rates]
        ),
        "quality-sketches",
    )

    def merged(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.sum("n").alias(f"{prefix}n"),
            *[F.kll_merge_agg_double(name, F.lit(SKETCH_K)).alias(f"{prefix}{name}") for name in rates],
        )

    by_lang = merged(fine, ["lang_key"], "lang_")
    everything = merged(fine, [], "all_")
    both = fine.join(by_lang, "lang_key").join(F.broadcast(everything))  # one row, so not a product

    def fence(sketch: str, name: str, upper: bool) -> Column:
        q1, q2, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.5, 0.75))
        wide = SPREAD * (q3 - q1)
        return F.greatest(q3 + wide, q2 + F.lit(UPPER[name])) if upper else F.least(q1 - wide, q2 - F.lit(LOWER[name]))

    def blended(name: str, upper: bool) -> Column:
        found = fence(f"lang_{name}", name, upper)
        if name not in OWN:
            found = (F.col("lang_n") * found + BLEND * fence(f"all_{name}", name, upper)) / (F.col("lang_n") + BLEND)
        found = (F.col("n") * fence(name, name, upper) + BLEND * found) / (F.col("n") + BLEND)
        middle = F.kll_sketch_get_quantile_double(f"lang_{name}", F.lit(0.5))
        wider = F.abs(found - middle) * WIDER / F.sqrt(F.col("lang_n").cast("double"))
        return found + wider if upper else found - wider

    out = [F.col("lang_key"), F.col("source_key")]
    out += [blended(name, True).alias(f"high_{name}") for name in UPPER]
    out += [blended(name, False).alias(f"low_{name}") for name in LOWER]
    return written(both.select(*out), "quality-fences")


def judge(counted: DataFrame, counts: str, limits: DataFrame, lang: str, source: str, into: str) -> DataFrame:
    """``counted`` with a boolean column ``into``: passes the base rules and lies within its group's fences.

    A document's tolerance grows as it gets shorter, since rates of few words vary more.
    """
    keys = (_group(counted, lang) == limits.lang_key) & (_group(counted, source) == limits.source_key)
    slack = 1 + 6 / F.sqrt(F.greatest(F.col(f"`{counts}`.n_words"), F.lit(1)).cast("double"))
    inside = F.lit(True)
    for name, value in _rates(counts).items():
        inside &= value <= limits[f"high_{name}"] * slack
        if name in LOWER:
            inside &= value * slack >= limits[f"low_{name}"]
    verdict = ~base_failed(counts) & F.coalesce(inside, F.lit(True))
    return counted.join(broadcast_if_small(limits), keys, "left").withColumn(into, verdict).drop(*limits.columns)


def quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document: id, the counts of its whole text, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails. Null languages and sources form groups of their own. A group of any
    size has fences of its own, blended with its language's and those of everything the more, and standing the farther
    out, the fewer documents there are; word length is never judged by other languages. Rows are judged one by one, so
    repeated rows are all returned; an empty table gives no rows.
    """
    counted = written(
        docs.select(
            column(docs, doc_id).alias("doc_id"),
            column(docs, lang).alias("lang"),
            column(docs, source).alias("source"),
            text_counts(column(docs, text)).alias("counts"),
        ),
        "quality-counts",
    )
    judged = judge(counted, "counts", fences(counted, "counts", "lang", "source"), "lang", "source", "kept")
    return judged.select("doc_id", "counts.*", base_failed("counts").alias("base_failed"), "kept")


def drop_low_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without the documents the rules reject, all columns as they were.

    The texts are counted twice, once for the fences and once for the verdict, instead of being moved.
    """
    rows = docs.select(
        F.struct(*[column(docs, name) for name in docs.columns]).alias("row"),
        column(docs, lang).alias("lang"),
        column(docs, source).alias("source"),
        text_counts(column(docs, text)).alias("counts"),
    )
    limits = fences(written(rows.drop("row"), "quality-counts"), "counts", "lang", "source")
    return judge(rows, "counts", limits, "lang", "source", "kept").where("kept").select("row.*")
