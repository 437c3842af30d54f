"""No cap and no rounding: small values, large ones, labels far out, long keywords, hot keys."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators import grid as G
from gridweave.operators import metrics as M
from gridweave.operators import coverage, fill, scaling
from gridweave.plans import filling, labels, load
from gridweave.plans.catalog import table
from gridweave.plans.coverage import segments
from gridweave.rules.sets import Kpi, RuleSet, Topic


def test_sums_keep_small_and_large_values(make):
    df = make([("a", 0.00004)] * 10 + [("b", 2e15), ("b", 1.0), ("c", float("inf")), ("d", float("nan"))], "sheet string, v double")
    got = {(r.sheet, r.metric): r.value for r in M.wide_metrics(df, ["sheet"], {"v": F.col("v")}, ["sum", "avg"]).collect()}
    assert math.isclose(got["a", "sum"], 0.0004) and math.isclose(got["a", "avg"], 0.00004) and got["b", "sum"] == 2e15 + 1
    assert got["c", "sum"] == float("inf") and math.isnan(got["d", "sum"])
    rows = make([("d", "s", i, "x", 0.00004) for i in range(10)], "doc_id string, sheet string, row_idx int, column string, value double")
    assert math.isclose(M.cross_sheet(rows).first()["sum"], 0.0004)


def test_a_named_scale_is_exact_or_an_error(make):
    df = make([(0.1,)] * 10, "v double")
    assert df.agg(S.exact_sum("v", 1)).first()[0] == 1.0
    with pytest.raises(PySparkException, match="decimals"):
        make([(0.15,)], "v double").agg(S.exact_sum("v", 1)).collect()


def test_labels_are_found_on_the_whole_sheet(grid):
    rows = [["项目", "金额"]] + [[f"r{i}", str(i)] for i in range(2, 400)] + [["合计", None]]
    rows.append([None] * 24 + ["平均值"])
    cells = grid(rows)
    heads = G.detect_header(cells)
    assert {r.cell for r in G.label_anchors(cells, heads).collect()} >= {"A400", "Y401"}
    assert not {r.cell for r in G.label_anchors(cells, heads, (300, 20)).collect()} & {"A400", "Y401"}


def test_long_keywords_are_found(make):
    long = "abc" * 27
    texts = make([(1, f"x {long} y {long}"), (2, f"x {long[:-1]}z"), (3, "abcabc")], "id int, text string")
    found = scaling.find_keywords(texts, "text", make([(long,), ("abcabc",)], "keyword string"), "keyword", "id")
    assert {(r.id, r.keyword, r.hits) for r in found.where(F.length("keyword") > 64).collect()} == {(1, long, 2)}


def test_positions_of_texts_are_never_broadcast(make):
    texts = make([(1, "hot bolt hot bolt of"), (2, None), (None, "bolt")], "id int, text string")
    found = scaling.find_keywords(texts, "text", make([("bolt",), ("hot bolt",), ("b" * 70,)], "keyword string"), "keyword", "id")
    assert {(r.id, r.keyword, r.hits) for r in found.collect()} == {(1, "bolt", 2), (1, "hot bolt", 2), (None, "bolt", 1)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [__gram" in plan and "BroadcastHashJoin [__gram" not in plan and plan.count("posexplode") == 1


def test_rules_of_any_size():
    words = tuple(f"word{i}" for i in range(3000))
    assert len(RuleSet({"p": "P"}, {"p": []}, (Topic("t", "T", "p", words),), (Kpi("k", "p", ("k",)),)).topics[0].keywords) == 3000


def test_a_hot_key_is_joined_and_numbered_right(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert scaling.attach(rows, facts, ["k"]).where("k = -1 AND n = 18000").count() == 18000
    numbered = scaling.number_rows(rows, ["k"], [F.col("id")], scaling.row_block("id", 500), "n")
    assert numbered.where("k = -1").agg(F.max("n"), F.count_distinct("n")).first()[:] == (18000, 18000)


def test_spread_tables_are_not_put_together_by_their_bytes(spark):
    folder = "/root/testdata/sf0.001"
    assert table(spark, folder, "documents", "doc_id").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_line_items_are_made_unique_without_a_second_shuffle(spark):
    plan = segments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2  # documents and line items, each dealt once


def test_compact_facts_count_kpis_and_keep_the_samples(make):
    rows = [("c", f"d{i}", i, f"n{i}", i % 3, "s", "l", kind, rule, None, topic, 1.0, "", f"x{i}") for i in range(50) for kind, rule, topic in (("kpi", "k", "t"), ("kpi", "k", None), ("topic", "t", "t"), ("pillar", "p", None))]
    facts = make(rows, "company string, doc_id string, doc_idx int, doc_name string, seg_idx int, segment_id string, location string, kind string, rule string, pillar string, topic string, value double, unit string, excerpt string")
    compact = coverage.compact_facts(facts)
    assert {(r.topic, r.n) for r in compact.where("kind = 'kpi'").collect()} == {("t", 50), (None, 50)}
    for form in (facts, compact):
        assert [tuple(r) for r in coverage.topic_facts(form).collect()] == [("c", "t", 50, 50, 50, "x0", "l", "n0", "d0")]
    matrix = make([("c", "t", 0, "T", "covered", "n0", "l", "x0")], "company string, topic string, rule_idx int, label string, status string, sample_document string, sample_location string, sample string")
    numbered = coverage.evidence_links(matrix, coverage.kpi_facts(facts.withColumn("pillar", F.lit("p"))))
    want = [("c", 101, 101, 0, 1, 100)]
    assert [tuple(r) for r in coverage.link_stats(numbered).collect()] == want
    assert [tuple(r) for r in coverage.link_stats(coverage.counted_links(matrix, compact)).collect()] == want
    first = coverage.first_links(matrix, coverage.kpi_facts(facts.withColumn("pillar", F.lit("p"))), 2).collect()
    assert sorted((r.link_id, r.document) for r in first) == [("link_1", "n0"), ("link_2", "n0")]


def test_work_on_small_tables_is_dealt(spark):
    folder, parts = "/root/testdata/sf0.001", 4 * spark.sparkContext.defaultParallelism
    assert filling.header_pairs(spark, folder).rdd.getNumPartitions() >= parts
    assert labels.part_cells(spark, folder).rdd.getNumPartitions() >= parts
    assert "hashpartitioning(p_partkey" in load().queries["grid_roundtrip"](spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_cut_before_they_are_dealt(spark):
    plan = load().queries["evidence_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.rindex("Exchange hashpartitioning(doc_id"):]
    assert "regexp_replace" not in read and "split(" not in read


def test_only_rows_of_jobs_without_audit_are_numbered(make):
    audit = make(
        [("p", "map_1", "T", "B1", "written", "1", "sum"), ("m", None, "R", None, "result_sheet_created", None, None), ("b", "map_1", "T", "B2", "written", "1", "avg"),
         ("b", None, "R", None, "result_sheet_created", None, None), ("e", None, None, None, "result_sheet_created", None, None), ("n", "map_1", "T", "B3", None, "1", "sum")],
        "job_id string, mapping_id string, sheet string, cell string, status string, value string, metric string",
    )
    rows = make([(j, i, "sum", f"{i}", 7) for j in ("p", "m", "b", "e", "n", "l") for i in (3, 70000)], "job_id string, map_idx int, metric string, value string, result_col int")
    report = fill.fill_report(audit, rows)
    told = [("p", "map_1", "written", "T", "B1", "sum", "1"), ("b", "map_1", "written", "T", "B2", "avg", "1")]
    listed = [(j, "", "result_sheet_written", s, f"G{n + 1}", "sum", v) for j, s in (("m", "R"), ("b", "R"), ("e", None)) for n, v in ((1, "3"), (2, "70000"))]
    lost = [(j, f"row_{n}", "not_written", "", "", "sum", v) for j in ("l",) for n, v in ((1, "3"), (2, "70000"))]
    assert sorted(map(str, map(tuple, report.collect()))) == sorted(map(str, told + listed + lost))
    # Blocks are added up once and numbered once; before, both were done for listed and for lost rows.
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
