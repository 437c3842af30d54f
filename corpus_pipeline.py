"""The corpus pipeline: documents without toxic texts, near copies and secrets, mixed by source and encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe_codec, mixing, ngram_join, secret_scan, toxicity
from gridweave.llm.common import documents, settle
from gridweave.llm.queries import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer, trained on this input, does not reject."""
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, scorer)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_one_of_each(docs, ngram_join.link_documents(docs, words=5, percent=80))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars counted anew."""
    found, _ = secret_scan.scan_history(docs)
    return secret_scan.redact_secrets(docs, found).withColumn("n_chars", F.length("text").cast("bigint"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and parts of documents so that sources meet their weights, with n_chars counted anew."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of ids and decoded text for each row of the mix."""
    return bpe_codec.codec_digest(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("codec", encoded),
]

# Learned scores and merges by rank are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one returns is settled for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
