"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

The stages filter by quality, drop exact copies, keep one document of each group of near copies, replicate
sources towards their target weights and pack what is left into sequences. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callharmony.llm.exact import drop_copies
from callharmony.llm.jaccard import drop_near_copies
from callharmony.llm.mixing import mix
from callharmony.llm.packing import pack
from callharmony.llm.quality import drop_low_quality
from callharmony.llm.tables import ship, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the fences of their language and source."""
    ship(spark)
    return drop_low_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, that with the largest id."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    ship(spark)
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in a random order over the whole corpus."""
    return mix(docs).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it stands in which sequence."""
    ship(spark)
    return pack(docs).pieces


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mix sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

# Sketches, shingle sets and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
