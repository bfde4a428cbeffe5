"""The corpus pipeline: what is kept of ``documents``, stage by stage, and its token counts.

Each stage is a function of (spark, docs, folder of the tables).  ``run`` writes
every stage as Parquet to the shared scratch folder and reads it back for the
next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import bpe, decontaminate, near_dup, quality_rules, secret_scan
from sextant.scratch import materialize

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id."""
    return near_dup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document; the tokens decode again."""
    import public_tokenizers

    return bpe.token_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("bpe_codec", encoded),
]

#: Fitting by expectation-maximisation, signatures and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
