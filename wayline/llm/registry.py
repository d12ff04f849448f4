"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import (
    decontaminate,
    divergence,
    hard_negatives,
    html_extract,
    line_dedup,
    minhash_dedup,
    pii,
    pipeline,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.query,
        "op2_quality_classifier": quality_classifier.query,
        "op3_simhash_vptree": simhash_dedup.query,
        "op4_sentencepiece": sentencepiece_codec.query,
        "op5_html_extraction": html_extract.query,
        "op6_quality_rules": quality_rules.query,
        "op7_decontamination": decontaminate.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_url_filters": url_filter.query,
        "op10_line_dedup": line_dedup.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_source_divergence": divergence.query,
        "op13_minhash": minhash_dedup.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_decontamination": decontaminate.SQL,
        "op8_substring_dedup": substring_dedup.SQL,
        "op9_url_filters": url_filter.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op12_source_divergence": divergence.SQL,
        "op13_minhash": minhash_dedup.SQL,
    }
