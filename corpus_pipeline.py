"""The training-data pipeline: five stages, each one operator's decision on what the one before has kept.

Every stage but the last gives rows with all columns of its input; the last gives doc_id, ids,
n_tokens, ids_crc32 and decoded.

Edge cases: null, empty and blank texts have no words, so the first stage drops them. Null
doc_ids stay; rows that repeat a text are one class, of which the smallest doc_id stays, and
repeated rows leave one. Very long texts go through whole. An empty table goes through as
one. Other columns are carried, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphsieve.llm import decontaminate, pii, quality, simhash, transducer
from glyphsieve.llm.common import tokenizer, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    return quality.keep(docs, tokenizer(quality.MODEL))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, 0.8 of the fingerprint's bits."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of the benchmark occurs."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, decoded."""
    return transducer.encode(docs, tokenizer(transducer.MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("sentencepiece encoding", encoding),
]

#: Fingerprint hashes, trained patterns and the tokenizer are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, f"stage-{at}")
    return docs
