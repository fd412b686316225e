"""The corpus pipeline: stages over ``documents``, each written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tessera.llm import bpe_tree, exact_quotient, language_kernel, mixing_tree, simhash_mih
from tessera.sources.sinks import scratch_path


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Below this score a language is not taken as recognised.
MIN_LANGUAGE_SCORE = 0.1
#: Whole texts travel to Python in batches of so many rows.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: their buffers stand in the JVM and in every
    Python worker of an executor at once. Changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a recognised language go (null and
    letterless texts, scores below MIN_LANGUAGE_SCORE)."""
    _small_batches(spark)
    return language_kernel.keep_known(docs, language_kernel.train(docs), MIN_LANGUAGE_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts the kept row stays."""
    _small_batches(spark)
    return exact_quotient.drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 with its contract's shingles and bits: one document of each group stays."""
    _small_batches(spark)
    return simhash_mih.drop_near_copies(docs, shingle=3, max_bits=3)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every copy of a document that the mix takes is a row."""
    _small_batches(spark)
    return mixing_tree.mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids of every row, with digests of them and of their decoding."""
    _small_batches(spark)
    spec = bpe_tree.read_spec(TOKENIZER)
    return bpe_tree.digests(bpe_tree.encode(docs, spec), "ids")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Fingerprints and merges cannot be stated in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
