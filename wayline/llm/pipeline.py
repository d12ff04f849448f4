"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; ``run``
writes each stage's result as Parquet to the shared folder and reads it again for the next one. All but the
last return the columns they got, extra ones included; an empty table gives an empty result in all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import decontaminate, line_dedup, quality_classifier, sentencepiece_codec, simhash_dedup
from wayline.llm.common import read, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; word vectors come from ``docs`` themselves.

    Null and empty texts are scored as texts without words; a null id and repeated rows are scored alike and
    stay or go together; a score of exactly one half stays; very long texts are pooled whole.
    """
    scored = quality_classifier.score(docs, read(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those that lose every line go.

    Null and empty texts and rows with a null id stay as they are; rows that repeat an id are never earlier
    than each other and are treated alike; of equal lines the one with the smallest (doc_id, line) stays.
    """
    return line_dedup.dedup_lines(docs, line_dedup.TAU, line_dedup.NEAR_CHARS, line_dedup.EQUAL_CHARS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null and empty texts are one group; rows with a null id stay; rows that repeat the id that stays are one.
    """
    return simhash_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Null and empty texts overlap nothing; rows with a null id stay; repeated rows go or stay together.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its ids, their number, and whether they decode to its text.

    Null and empty texts have no ids and decode to the empty text; every row, repeated or of a null id, is encoded.
    """
    both = sentencepiece_codec.encode(docs, verify=True)
    return both.select("doc_id", "source", "lang", "n_tokens", "round_trip", "ids")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece_encoding", encoding),
]

#: The classifier and the encoding have no SQL; tests/llm hold stages two to five against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
