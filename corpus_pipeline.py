"""A training corpus from raw documents: classify, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm.exact_dedup import drop_exact_copies
from strata.llm.mixing import mixed
from strata.llm.ngram_join import drop_similar
from strata.llm.packing import pack_in_order
from strata.llm.quality_classifier import drop_low_quality
from strata.llm.queries import MIX_WEIGHTS, table, tokenizer_path
from strata.llm.staging import Stage, scope


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more)."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return drop_exact_copies(docs, keep="min")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8."""
    return drop_similar(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mixture at the target weights."""
    return mixed(docs, MIX_WEIGHTS, whole=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids and their places in sequences of 4096: each sequence from one stretch of the mixture."""
    return pack_in_order(docs, tokenizer_path(), end_id=2, capacity=4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier and tokenised sequences are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage's operator has staged is deleted when its result is written, and a stage's documents when the next one's
    are. The last result is read lazily, so the documents it is made of stay until the caller clears them
    (``staging.scope``). Documents with null or empty texts pass like any other; empty tables give no rows.
    """
    stage = Stage(spark, "corpus_pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        with scope():
            docs = stage.put(step(spark, docs, sf_dir), name)
        if before:
            stage.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
