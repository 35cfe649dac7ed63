"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit_packing,
    byte_bpe,
    centroid_clustering,
    chat_formatting,
    histogram_sharding,
    language_id,
    ngram_jaccard_join,
    periodic_runs,
    pii,
    quality_classifier,
    quality_rules,
    spotsigs,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_spotsigs": spotsigs.op3_spotsigs,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_best_fit_packing": best_fit_packing.op5_best_fit_packing,
        "op6_histogram_sharding": histogram_sharding.op6_histogram_sharding,
        "op7_pii": pii.op7_pii,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_ngram_jaccard_join": ngram_jaccard_join.op9_ngram_jaccard_join,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_chat_formatting": chat_formatting.op12_chat_formatting,
        "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op11_periodic_runs": periodic_runs.ORACLE_SQL,
        "op12_chat_formatting": chat_formatting.ORACLE_SQL,
        "op13_centroid_clustering": centroid_clustering.ORACLE_SQL,
    }
