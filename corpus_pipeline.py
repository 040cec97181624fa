"""A corpus pipeline of five stages, each applying one operator to all that its predecessor kept.

quality rules -> n-gram Jaccard join -> substring dedup -> secret scans -> best-fit packing. Every stage is written as
Parquet and read again as the next one's input, so a lost executor costs a stage at most. All stages but the last
return the columns of ``documents``; the last returns bins. Nulls, empty texts and repeated rows are treated as in
the operators' docstrings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fragmill.llm.common import materialise, workers_find_package
from fragmill.llm.jaccard_join import keep_one_each
from fragmill.llm.packing import pack
from fragmill.llm.quality_rules import keep_good
from fragmill.llm.secret_scan import redact
from fragmill.llm.substring_dedup import dedup_substrings

#: The vocabulary whose tokens are packed.
VOCABULARY = "byte_bpe_50k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those of null or empty text among them; frequent lines of the others are cut."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the least doc_id, one of null doc_id only among its like.

    Rows equal in doc_id and text count as one; rows without words all stay.
    """
    workers_find_package(spark)
    return keep_one_each(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that an earlier document, or an earlier place, already has go; rows of null doc_id pass unchanged."""
    workers_find_package(spark)
    return dedup_substrings(docs).drop("n_sentences_removed", "n_words_removed")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a placeholder; null and empty texts stay as they are."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences by their tokens; those without a token are in none, copies are packed each."""
    import public_tokenizers

    workers_find_package(spark)
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Best-fit packing isn't expressible in SQL; tests/llm holds brute-force versions of the stages' operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
