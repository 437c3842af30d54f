"""Metrics, grids, roles and filling on small workbooks with results derived by hand."""

from pyspark.sql import functions as F

from gridweave.operators import fill as L
from gridweave.operators import grid as G
from gridweave.operators import labels as B
from gridweave.operators import metrics as M
from gridweave.operators import roles as R
from gridweave.operators import scaling


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_expense_metrics(make):
    df = make([("打车", 128.0), ("酒店", 523.6)], "item string, amount double")
    got = {(r.metric, r.value) for r in M.wide_metrics(df, [], {"金额": F.col("amount")}, ["sum", "avg", "count", "ratio"]).collect()}
    assert got == {("sum", 651.6), ("avg", 325.8), ("count", 2.0)}


def test_groups_and_result_rows(make):
    df = make([("销售部", 120.0), ("研发部", 80.0), ("销售部", 30.0), ("", 1.0), (None, None)], "dept string, v double").withColumn("sheet", F.lit("S"))
    grouped = M.wide_metrics(df.withColumn("group_value", M.group_label("dept")), ["sheet", "group_value"], {"金额": F.col("v")}, ["sum"])
    assert as_set(grouped, "group_value", "value") == {("销售部", 150.0), ("研发部", 80.0), ("空值", 1.0)}
    overall = M.wide_metrics(df, ["sheet"], {"金额": F.col("v"), "其他": F.col("v")}, ["sum"])
    rows = M.result_rows(overall, grouped.withColumn("group_col", F.lit("部门")), ["sheet", "column"])
    assert as_set(rows.where("group_value IS NULL"), "column") == {("其他",)} and rows.count() == 4


def test_filter_falls_back_per_sheet(make):
    df = make([("a", 1, "2025-01", 1.0), ("a", 2, "2024", 2.0), ("b", 3, "2023", 5.0)], "sheet string, row_idx int, t string, v double")
    hit = M.row_hit([F.col("t")], ["2025"])
    assert as_set(M.time_filter(df, ["sheet"], "row_idx", hit), "row_idx") == {(1,), (3,)}
    assert as_set(M.wide_metrics(df, ["sheet"], {"v": F.col("v")}, ["sum"], hit=hit), "sheet", "value") == {("a", 1.0), ("b", 5.0)}


def test_cross_sheet_and_trend(make):
    rows = [("d", "Jan", 1, "Scope 1", 100.0), ("d", "Jan", 2, "Scope 1", 110.0), ("d", "Jan", 1, "Scope 2", 200.0), ("d", "Jan", 2, "Scope 2", 220.0),
            ("d", "Feb", 1, "Scope 1", 120.0), ("d", "Feb", 2, "Scope 1", 150.0), ("d", "Feb", 1, "Scope 2", 240.0), ("d", "Feb", 2, "Scope 2", 260.0)]
    got = {r.column: r for r in M.cross_sheet(make(rows, "doc_id string, sheet string, row_idx int, column string, value double")).collect()}
    assert got["Scope 1"]["sum"] == 480 and got["Scope 1"].ratio == 480 / 1400 and got["Scope 2"].source_sheets == "Feb, Jan"
    months = make([(1, "1月", 10.0), (2, "2月", 20.0), (3, None, 99.0), (4, "3月", 25.0)], "row_idx int, month string, v double").withColumn("s", F.lit("x"))
    assert as_set(M.trend(months, ["s"], {"v": F.col("v")}, "row_idx", F.col("month"), ["yoy", "mom"]), "metric", "value") == {("yoy", 0.25), ("mom", 0.25)}


def test_column_choice_and_plan(make):
    columns = make([("d", "S", 1, "部门", False), ("d", "S", 2, "金额", True), ("d", "S", 3, "人数", True)], "doc_id string, sheet string, col_idx int, header string, is_numeric boolean")
    requests = make([(1, "d", "按部门 求和 cost"), (2, "d", "平均")], "request_id int, doc_id string, request string")
    assert as_set(M.select_columns(columns, requests), "request_id", "header") == {(1, "金额"), (2, "金额"), (2, "人数")}
    assert as_set(M.group_column(columns, requests), "request_id", "group_col") == {(1, "部门")}
    plan = M.plan_calculations(columns, requests)
    assert as_set(plan, "request_id", "calculation_id", "label") == {(1, "calc_1", "按部门金额合计"), (2, "calc_1", "金额平均值"), (2, "calc_2", "人数平均值")}


OFFSET = [["能源排放汇总", None, None], [None], ["月份", "排放量", "单位"], [None], ["1月", 128, "吨"], ["2月", 132, "吨"]]
LABELS = [["ESG 指标汇总", None], ["合计", None], ["平均值", None]]


def test_profile_offset_header(grid):
    row = G.sheet_profile(grid(OFFSET)).first()
    assert row.header_row == 3 and row.header_confidence in ("medium", "high") and row.sheet_role == "source_like"
    assert row.headers == ["月份", "排放量", "单位"] and row.numeric_columns == ["排放量"] and row.row_count == 2


def test_profile_labels(grid):
    cells = grid(LABELS)
    anchors = G.label_anchors(cells, G.detect_header(cells))
    assert as_set(anchors, "cell", "metric") == {("A2", "sum"), ("A3", "avg")}
    zones = as_set(G.value_zones(cells, anchors), "anchor_cell", "cell")
    assert {("A2", "B2"), ("A3", "B3")} <= zones and len(zones) == 6


def test_wide_sheet_names_and_late_header(grid):
    wide = [[f"列{c}" for c in range(1, 14)], *[[f"值{r}_{c}" for c in range(1, 14)] for r in range(1, 61)]]
    profile = G.sheet_profile(grid(wide)).first()
    assert profile.row_count == 60 and profile.headers[-1] == "列13"
    odd = [["金额", "金额", None, "金额_2", "单位"], [1, 2, 3, 4, 5]]
    assert G.sheet_heads(grid(odd)).first().headers == ["金额", "金额_2", "column_3", "金额_2_2", "单位"]
    late = [[None]] * 10 + [["金额", "x"], [1, 2]]
    head = G.sheet_heads(grid(late)).first()
    assert head.header_row == 11 and head.headers == ["金额", "x"] and head.header_confidence == "low"


def test_row_blocks(grid):
    cells = grid([["金额", "单位"], *[[i, "元"] for i in range(10)]])
    blocks = {r.seg_idx: r for r in G.row_blocks(G.records(cells, G.sheet_heads(cells))).collect()}
    assert (blocks[1].row_start, blocks[1].row_end, blocks[2].label) == (2, 9, "Sheet1 行 10-11")
    assert blocks[2].text == "第 10 行：金额=8；单位=元\n第 11 行：金额=9；单位=元"


def test_roles(grid, make):
    profile = G.sheet_profile(grid(OFFSET, "s", "明细", "detail.xlsx").unionByName(grid(LABELS, "t", "汇总", "template.xlsx")))
    requests = make([(1, "fill it", "s", "detail.xlsx", 0), (1, "fill it", "t", "template.xlsx", 1), (2, "one", "t", "template.xlsx", 0)], "request_id int, request string, doc_id string, doc_name string, doc_idx int")
    roles = R.select_roles(R.role_scores(requests, profile))
    assert as_set(roles, "request_id", "doc_id", "role") == {(1, "s", "source"), (1, "t", "template"), (2, "t", "source_and_template")}
    assert as_set(R.calculation_sources(requests, profile), "request_id", "doc_id") == {(1, "s"), (2, "t")}
    sources = make([(1, "detail.xlsx")], "request_id int, doc_name string")
    assert as_set(R.target_document(requests, profile, sources), "request_id", "doc_id") == {(1, "t"), (2, "t")}
    assert as_set(R.best_source_table(requests, profile), "request_id", "doc_id", "sheet") == {(1, "s", "明细"), (2, "t", "汇总")}
    assert R.role_warnings(roles).count() == 2


def test_keyed_fill(make):
    source = make([(1, "A-001", "差旅费", "128"), (2, "A-002", "住宿费", "523.6"), (3, "***", "x", "9")], "r int, k string, name string, amount string")
    target = make([(2, "A-001", "差旅费", None), (3, "a 002", "住宿费", None), (4, None, None, None)], "row int, code string, label string, total string")
    job = L.KeyedFill(source, target, ("k", "code"), [("name", "label", 1.0), ("amount", "total", 1.0)], "r", "row")
    # The label column has no blank cell on a matched row, so it is not part of the fill.
    assert as_set(job.audit(), "target_row", "target_col", "status", "value") == {(2, "total", "written", "128"), (3, "total", "written", "523.6")}
    assert as_set(job.filled(), "row", "total") == {(2, "128"), (3, "523.6"), (4, None)}


def test_several_source_rows_for_one_cell(make):
    source = make([(1, "k", "-"), (2, "k", "7"), (3, "k", "7.0"), (4, "k", "8"), (5, "k", None)], "r int, k string, v string")
    target = make([(2, "k", None), (3, "k", None)], "row int, k string, v string")
    audit = L.KeyedFill(source, target, ("k", "k"), [("v", "v", 0.72)], "r", "row").audit()
    assert as_set(audit, "source_row", "target_row", "status", "risk_level") == {
        (1, 2, "written", "medium"), (2, 2, "written", "medium"), (3, 2, "kept_existing", "medium"), (4, 2, "preserved_existing", "medium"), (5, 2, "source_empty", "medium"),
    }


def test_append(make):
    source = make([("p", 1, "打车", "128"), ("p", 2, None, None), ("p", 3, "酒店", "523.6")], "p string, r int, a string, b string")
    target = make([("p", 2, "x", None), ("p", 3, None, "-")], "p string, row int, a string, b string")
    placed = L.append_rows(source, target, ["p"], [("a", "a", 1.0), ("b", "b", 1.0)], "r", "row")
    assert as_set(placed.where("status = 'written'"), "source_row", "cell", "value") == {(1, "A3", "打车"), (1, "B3", "128"), (3, "A5", "酒店"), (3, "B5", "523.6")}


RESULT_SCHEMA = "job_id string, mapping_id string, map_idx int, metric string, group_value string, column string, group_col string, source_sheet string"


def label_grid(make, rows):
    flat = [("j", "T", r, c, str(v)) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v is not None]
    return make(flat, "job_id string, sheet string, row_idx int, col_idx int, value_str string")


def test_labels_by_context_and_group(make):
    cells = label_grid(make, [["费用汇总"], ["金额合计"], ["人数合计"], ["销售部合计"], ["合计"]])
    rows = make([("j", "map_1", 1, "sum", None, "金额", None, "S"), ("j", "map_2", 2, "sum", None, "人数", None, "S"), ("j", "map_3", 3, "sum", "销售部", "额度", "部门", "S")], RESULT_SCHEMA)
    found = B.match_labels(B.label_cells(cells), rows)
    # The bare total fits three rows alike: no match.
    assert as_set(found, "row_idx", "mapping_id", "score") == {(2, "map_1", 64), (3, "map_2", 64), (4, "map_3", 66)}
    lone = B.match_labels(B.label_cells(cells), rows.where("map_idx = 1"))
    assert (5, "map_1", 70) in as_set(lone, "row_idx", "mapping_id", "score")


def test_many_labels_and_candidates(make):
    cells = label_grid(make, [["汇总表"], *[[f"项目{i:03d}合计", "600" if i == 2 else None] for i in range(1, 121)]])
    rows = make([("j", f"map_{i}", i, "sum", f"项目{i:03d}", "金额", "项目", "明细") for i in range(1, 121)] + [("j", "map_x", 121, "avg", "无", "金额", "项目", "明细")], RESULT_SCHEMA)
    found = B.match_labels(B.label_cells(cells), rows)
    assert as_set(found, "row_idx", "mapping_id") == {(i + 1, f"map_{i}") for i in range(1, 121)}
    ranked = B.rank_candidates(B.value_positions(found, cells), rows)
    best = {r.mapping_id: r for r in ranked.where("rank = 1").collect()}
    assert best["map_120"].cell == "B121" and best["map_120"].confidence == "medium" and best["map_1"].score == 0.914
    assert best["map_2"].score == 0.834 and best["map_x"].status == "manual_review_required" and best["map_x"].requires_confirmation


def candidates(make):
    schema = (
        "job_id string, mapping_id string, map_idx int, metric string, value string, status string, confidence string, risk_level string, requires_confirmation boolean, "
        "reasons array<string>, options array<struct<sheet:string,cell:string,score:double>>"
    )
    rows = [("j", f"map_{i}", i, "sum", v, "matched_label", "medium", "medium", False, ["r"], [("T", f"B{i + 1}", 0.9), ("T", f"C{i + 1}", 0.6)]) for i, v in ((1, "651.6"), (2, "10"))]
    return make(rows, schema)


def test_override_skip_overwrite_and_merged(make):
    cand = candidates(make)
    sheets = make([("j", "T")], "job_id string, sheet string")
    over = make([("j", "map_1", True, None, "c2", "force_overwrite", 0), ("j", "map_2", False, None, None, None, 0)], "job_id string, mapping_id string, enabled boolean, sheet string, cell string, write_policy string, candidate_index int")
    actions = L.gate_candidates(L.apply_overrides(cand, over, sheets))
    assert as_set(actions, "mapping_id", "action", "target_cell") == {("map_1", "write", "C2"), ("map_2", "skipped", "B3")}
    cells = make([("j", "T", 2, 3, "600")], "job_id string, sheet string, row_idx int, col_idx int, value_str string")
    none = make([], "job_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    assert as_set(L.write_candidates(actions, cells, none), "cell", "status", "existing_value") == {("C2", "written", "600")}
    merged = make([("j", "T", 2, 2, 2, 3)], "job_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    assert as_set(L.write_candidates(actions, cells, merged), "cell", "status") == {("C2", "blocked_merged_cell")}


def test_review_holds_back_the_job(make):
    verdicts = make([("j", "map_1", False, "high", "wrong cell", "T", "b3")], "job_id string, mapping_id string, approved boolean, risk_level string, issue string, suggested_sheet string, suggested_cell string")
    merged = L.merge_reviews(candidates(make), verdicts)
    row = merged.where("mapping_id = 'map_1'").first()
    assert (row.status, row.requires_confirmation, row.review_suggested_cell, row.reasons[-1]) == ("review_flagged", True, "B3", "Review 交叉检查：wrong cell")
    none = make([], "job_id string, mapping_id string, enabled boolean, sheet string, cell string, write_policy string, candidate_index int")
    actions = L.gate_candidates(L.apply_overrides(merged, none, make([("j", "T")], "job_id string, sheet string")))
    assert as_set(actions, "mapping_id", "action") == {("map_1", "requires_confirmation"), ("map_2", "held_back")}


def test_metric_rows(make):
    rows = make([("j", 1, "sum"), ("j", 2, "avg"), ("j", 3, "max"), ("j", 4, "max")], "job_id string, map_idx int, metric string")
    template = make([("j", 2, "sum"), ("j", 3, "sum"), ("j", 4, "max")], "job_id string, row_idx int, metric string")
    sheets = make([("j", "T", 4, 1, 2)], "job_id string, sheet string, max_row int, header_row int, result_col int")
    assert as_set(L.match_metric_rows(rows, template, sheets), "map_idx", "cell", "status") == {
        (1, "B3", "matched_existing_metric"), (2, "B5", "append_row"), (3, "B6", "append_row"), (4, "B7", "append_row"),
    }


def test_scaling_helpers(make):
    rows = make([("a", i, i % 3) for i in range(50)] + [("b", 7, 1)], "g string, i int, v int")
    numbered = scaling.number_rows(rows, ["g"], [F.col("i")], scaling.row_block("i", 8), "n")
    assert as_set(numbered.where("g = 'a'"), "i", "n") == {(i, i + 1) for i in range(50)}
    texts = make([(1, "aaa needle aa"), (2, "nothing")], "id int, t string")
    words = make([("aa",), ("needle",), ("x",)], "w string")
    assert as_set(scaling.find_keywords(texts, "t", words, "w", "id"), "id", "w", "hits") == {(1, "aa", 2), (1, "needle", 1)}
    found = scaling.find_tokens(make([(1, "项目001金额合计")], "id int, t string"), "t", make([("项目001",), ("金额",), ("项目002",), ("项目001金额合计合计",)], "w string"), "w", max_length=4)
    assert as_set(found, "w") == {("项目001",), ("金额",)}


def test_a_label_with_many_named_values_walks_existing_nodes_only(spark, make):
    """50 values of each of two fields in one label: one row has the named pair that no other row has."""
    values = [f"v{i:02d}x" for i in range(50)]
    rows = make(
        [("j", f"m{i}", i, "sum", v, f"c{v}", "gg", "ss") for i, v in enumerate(values)] + [("j", "other", 99, "sum", "v00x", "elsewhere", "gg", "ss")],
        "job_id string, mapping_id string, map_idx int, metric string, group_value string, column string, group_col string, source_sheet string",
    )
    text = "合计" + "".join(values[:1]) + "cv00x"
    cells = make([("j", "s", 5, 1, text), ("j", "s", 6, 1, "合计" + "".join(values) + "".join(f"c{v}" for v in values))], "job_id string, sheet string, row_idx int, col_idx int, value_str string")
    found = {r["row_idx"]: r["mapping_id"] for r in B.match_labels(B.label_cells(cells), rows).collect()}
    assert found == {5: "m0"}  # the second label names 50 rows equally well
    plan = B.match_labels(B.label_cells(cells), rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct(entry" not in plan
