"""Registered queries against their SQL on the smallest tables, and the shape of a few plans.

A selection runs by default; GRIDWEAVE_ALL=1 compares all of them (as `python check.py` does).
"""

import os

import pytest

import check
from gridweave.plans import load
from gridweave.registry import OPERATORS

FOLDER = "/root/testdata/sf0.001"
CATALOG = load()
CHOSEN = [
    "calc_basic", "calc_grouped", "calc_ratio", "calc_intensity", "calc_cross_sheet", "time_filter_fallback", "calc_filtered", "cell_values", "number_units", "merge_text", "page_split",
    "detect_header", "row_blocks", "keyed_fill", "append_rows", "candidate_writes", "label_match", "chunk_blocks", "budget_select", "topic_matrix", "kpi_extract", "evidence_links", "latest_per_key",
]
NAMES = list(CATALOG.sql) if os.environ.get("GRIDWEAVE_ALL") else CHOSEN

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    good, text = check.compare(CATALOG.queries[name](spark, FOLDER), con, CATALOG.sql[name])
    assert good, text


def plan(spark, name):
    return CATALOG.queries[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in CATALOG.queries if n.startswith("calc_")])
def test_metrics_stay_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "NestedLoop" not in text and "CartesianProduct" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "calc_ratio")
    assert "l_quantity" in text and "l_shipdate" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["audit_union", "fill_report", "finished_jobs", "fill_validate"])
def test_a_shared_audit_is_worked_out_once(spark, con, name):
    # What decides on the writes (a low priority asks for confirmation) was read anew wherever the audit was read.
    assert "o_orderpriority" not in plan(spark, name)
    good, text = check.compare(CATALOG.queries[name](spark, FOLDER), con, CATALOG.sql[name])
    assert good, text


def test_page_split_keeps_conversations_of_one_page(spark, tmp_path):
    rows = [(5, 0, "whole text"), (6, 0, "marked text"), (10, 0, "first"), (10, 1, "second"), (11, 0, "one"), (11, 1, "two")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in CATALOG.queries["page_split"](spark, str(tmp_path)).collect()}
    assert got == {(5, 1, "[no page]\nwhole text"), (6, 1, "marked text"), (11, 1, "one"), (11, 2, "two")}


def test_registry_lists_operators():
    assert len(OPERATORS) > 80 and "metrics.wide_metrics" in OPERATORS and all(f.__doc__ for f in OPERATORS.values() if f.__module__.startswith("gridweave.operators.fill"))
