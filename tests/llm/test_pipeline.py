"""The registered text queries and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
from gridweave.llm import ngram_join, secret_scan, toxicity
from gridweave.llm.queries import CATALOG

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
pytest.importorskip("public_tokenizers")


# Queries whose rows are not documents: pages, conversations, phrases.
OTHER_ROWS = ["op11_count_automata", "op12_seekable_warc", "op13_hirschberg_repair"]


def test_queries_of_other_tables_give_one_row_for_each_of_theirs(spark):
    pages, said = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("pages", "conversations"))
    assert CATALOG.queries["op12_seekable_warc"](spark, FOLDER).count() == pages.count()
    assert CATALOG.queries["op13_hirschberg_repair"](spark, FOLDER).count() == said.select("conv_id").distinct().count()


@pytest.mark.parametrize("name", [q for q in CATALOG.queries if q not in OTHER_ROWS])
def test_query_gives_one_row_per_document(spark, name):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert CATALOG.queries[name](spark, FOLDER).count() == n


@pytest.mark.parametrize("name", ["op6_jump_sharding", "op7_paragraph_sums", "op10_blob_ledger"])
def test_native_queries_stay_in_the_jvm(spark, name):
    plan = CATALOG.queries[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = stage(spark, docs, FOLDER).cache()
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    first, second, third, fourth, fifth = inputs
    scorer = toxicity.train(first, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r["doc_id"] for r in toxicity.score_texts(first, scorer).collect() if not r["predicted"]}
    assert {r["doc_id"] for r in second.collect()} == kept
    heads = {r["component_id"] for r in ngram_join.link_documents(second).collect()}
    assert {r["doc_id"] for r in third.collect()} == heads
    found, _ = secret_scan.scan_history(fourth)
    assert fourth.count() == third.count() and not [r for r in found.collect() if r["kind"] in ("access", "hex")]
    assert fifth.count() == docs.count() > 0
