"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fragmill.llm import bpe
from fragmill.llm.common import workers_find_package
from fragmill.llm.jaccard_join import jaccard_components
from fragmill.llm.language_id import identify
from fragmill.llm.neighbours import nearest_of_twentieths
from fragmill.llm.packing import pack
from fragmill.llm.quality_rules import quality
from fragmill.llm.secret_scan import secrets
from fragmill.llm.substring_dedup import dedup_substrings
from fragmill.llm.toxicity import toxicity
from fragmill.llm.url_filter import judge

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    @wraps(operator)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return query


def _op6(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs.select("doc_id", "text"))


def _op10(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id", "class_id")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _op1(docs: DataFrame) -> DataFrame:
    return bpe.digest(docs, _vocabulary())


def _op3(docs: DataFrame) -> DataFrame:
    return pack(docs, _vocabulary())


def _with_labels(table: str, operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

    return query


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": _on("documents", _op1),
        "op2_nearest_neighbours": _on("embeddings", nearest_of_twentieths),
        "op3_best_fit_packing": _on("documents", _op3),
        "op4_toxicity": _with_labels("documents", toxicity),
        "op5_secret_scan": _on("documents", secrets),
        "op6_substring_dedup": _on("documents", _op6),
        "op7_quality_rules": _on("documents", quality),
        "op8_language_id": _on("documents", identify),
        "op9_url_filter": _with_labels("pages", judge),
        "op10_jaccard_join": _on("documents", _op10),
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from fragmill.llm.oracles import ORACLES

    return dict(ORACLES)
