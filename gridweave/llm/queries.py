"""The registered queries of this subpackage: each applies an operator to the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm import bpe_codec, collocations, conversation_repair, fingerprints, mixing, ngram_join, private_data, repetition, secret_scan, sharding, sql, token_counts, toxicity, warc_bundles
from gridweave.llm.common import documents
from gridweave.plans.catalog import Catalog

CATALOG = Catalog()


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)

@CATALOG.add(sql.SHARDS)
def op6_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in 16 shards by jump consistent hashing, with gapless slots and the shard among 17."""
    return sharding.shard_rows(documents(spark, folder))


@CATALOG.add()
def op7_paragraph_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of documents and their edited texts as sums of paragraph vectors."""
    return fingerprints.fingerprint_edits(documents(spark, folder))


@CATALOG.add(sql.SECRETS)
def op10_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, each content scanned once."""
    return secret_scan.secret_digest(documents(spark, folder))


@CATALOG.add()
def op4_sainte_lague_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document in a mix of 150 % of all words at source weights 3, 1, 2."""
    return mixing.mix_sources(documents(spark, folder)).drop("copies")


@CATALOG.add()
def op1_pretoken_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, each distinct pre-token encoded once."""
    return token_counts.count_tokens(documents(spark, folder), vocabulary("byte_bpe_50k.json"))


@CATALOG.add()
def op9_rank_array_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded with a vocabulary of words."""
    return bpe_codec.codec_digest(documents(spark, folder), vocabulary("word_bpe_49k.json"))


@CATALOG.add()
def op3_suffix_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return repetition.judge_repetition(repetition.repetition(documents(spark, folder)))


@CATALOG.add()
def op5_channel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document after its disguised words are restored."""
    docs = documents(spark, folder)
    scorer = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.score_texts(docs, scorer)


@CATALOG.add()
def op2_bilstm_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, by patterns and by a character tagger."""
    docs = documents(spark, folder)
    return private_data.private_digest(private_data.find_private(docs, private_data.train_tagger(docs)))


@CATALOG.add()
def op8_prefix_orders_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are at least 85 % similar."""
    return ngram_join.link_documents(documents(spark, folder), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


@CATALOG.add()
def op13_hirschberg_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations, their faults, and the cheapest repair with its audit."""
    return conversation_repair.repair_digest(spark.read.parquet(f"{folder}/conversations.parquet"))


@CATALOG.add(sql.ARCHIVES)
def op12_seekable_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records into seekable bundles and read back."""
    return warc_bundles.archive_digest(spark.read.parquet(f"{folder}/pages.parquet"))


@CATALOG.add()
def op11_count_automata(spark: SparkSession, folder: str) -> DataFrame:
    """Collocations of two to five words per language, counted by weighted automata."""
    return collocations.top_collocations(documents(spark, folder))
