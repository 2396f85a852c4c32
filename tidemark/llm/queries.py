"""The opN_ queries and pipeline, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import decontaminate, fingerprints, language, ngram_join, packing, quality, quotes, sharding, suffix_array, superkmer
from .oracles import ORACLES


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(C.documents(spark, sf_dir), 50)


def op2_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(C.documents(spark, sf_dir))


def op3_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(C.documents(spark, sf_dir))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(C.documents(spark, sf_dir))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_conversations(C.table(spark, sf_dir, "conversations"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.dedup(C.documents(spark, sf_dir), 13)


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(C.documents(spark, sf_dir), C.table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(C.documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(C.documents(spark, sf_dir), C.table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_array_dedup, op2_byte_sharding, op3_bottom_k_fingerprints, op4_ngram_jaccard_join, op5_quotation_linking, op6_language_id, op7_superkmer_dedup, op8_simhash_decontamination, op9_best_fit_packing, op10_quality_classifier)
}

__all__ = ["ORACLES", "QUERIES"]
