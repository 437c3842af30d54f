"""Ranking, coverage, KPIs, reports, file sources and streams on small inputs."""

import html
import os
from html.entities import html5

from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.functions import segmentation as G
from gridweave.operators import coverage as C
from gridweave.operators import sets as A
from gridweave.operators import texts as T
from gridweave.rules import fixed
from gridweave.rules.sets import Kpi, RuleSet, Topic, default_rules
from gridweave.sources import cells as X
from gridweave.sources import files, sinks
from gridweave.streaming import jobs


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


NOTES = [
    (1, "climate_note.txt", "Renewable electricity reached 48%.\n\nScope 2 emissions went down 12%, to 18,350 tCO2e in 2024."),
    (2, "governance_note.txt", "The board ESG committee met 4 times.\n\nAnti-bribery training coverage was 100%."),
    (3, "people.txt", "Training coverage of employees was 91%."),
]


def documents(make):
    df = make([(i, n, t, "acme") for i, n, t in NOTES], "doc_id int, doc_name string, text string, company string")
    df = df.withColumn("doc_idx", F.col("doc_id")).withColumn("doc_type", F.lit("text")).withColumn("kinds", T.infer_kinds("doc_name", "doc_type", "text"))
    return T.with_segments(df)


def test_ranking_and_summary(make):
    scored = T.score_documents(documents(make), G.request_keywords(F.lit("anti-bribery, governance")))
    top = T.top_documents(T.relevant_documents(scored, ["company"]), ["company"], 6)
    rows = top.orderBy("doc_rank").collect()
    assert rows[0].doc_name == "governance_note.txt" and "anti-bribery" in rows[0].matched and rows[0].scored[0].text.startswith("Anti-bribery")
    summary = T.extractive_summary(T.spend_budget(top, ["company"], 2, 10), ["company"]).first().summary
    assert summary.startswith("1. governance_note.txt：Anti-bribery training coverage was 100%.")
    draft = T.excerpt_draft(T.spend_budget(top, ["company"], 3, 12).withColumn("task", F.lit("x")), ["company"], "task").first().draft
    assert draft.startswith("# 修订稿\n\n任务：x\n\n## 整理内容\n\n## governance_note.txt\n### 正文片段 2\n")


def test_nothing_matches_keeps_all(make):
    scored = T.score_documents(documents(make), G.request_keywords(F.lit("zzz qqq")))
    assert T.relevant_documents(scored, ["company"]).count() == 3


def segments(make):
    long = T.explode_segments(documents(make), ["company", "doc_id", "doc_idx", "doc_name"])
    return long.select("company", "doc_id", "doc_idx", "doc_name", "seg_idx", "segment_id", "location", "text")


def test_default_rules_kpis_and_matrix(make):
    rules, segs = default_rules(), segments(make)
    kpis = C.extract_kpis(segs, rules)
    got = {(r.metric, r.value, r.unit) for r in kpis.collect()}
    assert {("可再生电力占比", 48.0, "%"), ("范围二排放", 12.0, "%"), ("ESG 委员会会议次数", 4.0, "次"), ("反舞弊培训覆盖率", 100.0, "%"), ("培训覆盖率", 91.0, "%")} <= got
    compat = C.extract_kpis(segs, rules, compat=True, compat_first=True)
    assert as_set(compat, "topic") == {("gri_climate_emissions",)}
    # First topic in rule order whose words or patterns the text holds: "%" belongs to energy already.
    assert as_set(kpis.where("metric = '反舞弊培训覆盖率'"), "topic") == {("gri_energy_transition",)}
    matrix = C.topic_matrix(segs, rules)
    assert as_set(matrix, "status") <= {("covered",), ("weak",), ("missing",)} and matrix.count() == len(fixed.TOPICS)
    items = C.disclosure_matrix(matrix, kpis, C.standards(documents(make).select("company", S.clip("text", 180).alias("text"))))
    assert C.data_requests(items, rules).count() > 0
    links = C.evidence_links(matrix, kpis)
    assert sorted(r.link_no for r in links.collect()) == list(range(1, links.count() + 1))
    report = C.report_draft(items, kpis, links, C.standards(documents(make).select("company", S.clip("text", 180).alias("text"))), rules, F.lit("800 字")).first()
    for part in ("# ESG 报告草稿", "800 字", "## 管理层摘要", "## 环境", "## 关键绩效指标", "| 可再生电力占比 | 48 | % |", "## 数据缺口与后续动作", "## 证据索引"):
        assert part in report.report
    assert report.words > 60
    outline = C.outline(matrix, kpis, rules).first().markdown
    assert outline.startswith("# ESG 报告建议大纲\n## 1. 报告说明") and "## 关键指标附表" in outline


def test_thousands_and_years(make):
    df = make([("scope 1 was 18,350 tCO2e in 2024",)], "t string")
    assert df.select(C.best_number("t", ["tco2e"])["value"]).first()[0] == 18350.0
    assert df.select(C.best_number("t", ["tco2e"], compat=True)["value"]).first()[0] == 350.0


def test_sections_and_pages(make):
    df = make([(1, "Head\nFirst line is long enough to be no head at all.\nNext\ntext: no head")], "id int, text string")
    assert [r.section for r in T.line_sections(df, "id").orderBy("line_idx").collect()] == ["Head", "Head", "Next", "Next"]
    pages = make([(1, 1, "x" * 200), (1, 2, "")], "id int, page int, text string")
    assert T.needs_second_pass(pages, make([(1, 2), (2, 1)], "id int, page_count int"), "id").where("again").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("项目,金额\n打车,128\n酒店,523.6\n", encoding="utf-8")
    (tmp_path / "g.txt").write_bytes("环境报告：排放".encode("gb18030"))
    (tmp_path / "u.txt").write_text("plain ünïcode", encoding="utf-8")
    (tmp_path / "m.eml").write_text("Subject: Board\nFrom: a@b.c\nTo: d@e.f\nContent-Type: text/plain; charset=utf-8\n\nFacts: 4 meetings.\n", encoding="utf-8")
    path = str(tmp_path)
    cells = files.csv_cells(files.read_files(spark, path, "*.csv"))
    assert as_set(cells.where("col_idx = 2"), "sheet", "row_idx", "value_num") == {("a", 1, None), ("a", 2, 128.0), ("a", 3, 523.6)}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_bytes(b'x,"two\nlines, ""quoted""",\r\n\r\n1')
    (tmp_path / "bad.csv").write_bytes(bytes([0x81, 0x01, 0x02, 0xFF]) * 8)
    both = files.csv_cells(files.read_files(spark, path, "*.csv"))
    assert both.where("error IS NULL").select("doc_id").distinct().count() == 2 and both.where("error IS NOT NULL").select("doc_name").first()[0] == "bad.csv"
    nested = both.where("doc_id LIKE '%/sub/a.csv'")
    assert as_set(nested, "row_idx", "col_idx", "value_str") == {(1, 1, "x"), (1, 2, 'two\nlines, "quoted"'), (1, 3, None), (3, 1, "1")}
    assert as_set(files.text_files(files.read_files(spark, path, "*.txt")), "doc_name", "text", "doc_type") == {("g.txt", "环境报告：排放", "text"), ("u.txt", "plain ünïcode", "text")}
    mail = files.mail_files(files.read_files(spark, path, "*.eml")).first()
    assert mail.header == "主题：Board\n发件人：a@b.c\n收件人：d@e.f" and mail.body.strip() == "Facts: 4 meetings."


def test_html(make):
    pages = make([(1, "<h1>Code</h1><script>var x;</script><p>of <b>conduct</b> &amp; more</p>")], "id int, html string")
    assert files.html_text(pages, "id", "html").first().text == "Code var x; of conduct & more"
    assert files.html_text(pages, "id", "html", drop_script=True).first().text == "Code of conduct & more"
    odd = make([(1, "a<!-- x > y --> b&#8364;&#65;&amp;lt; <br/>c < d"), (2, None)], "id int, html string")
    assert as_set(files.html_text(odd, "id", "html"), "id", "text") == {(1, "a b€A&lt; c < d"), (2, "")}


def test_html_references_are_those_of_the_standard(make):
    texts = [
        "&eacute;&rsquo;&ldquo;&times;", "&#x27;&#X1F600;&#39;&#8217;", "caf&eacute &copy 2024 &ampamp; AT&T", "&notit; &notin; &unknown; &;&#;&#x;", "&amp;lt; &amp;amp;eacute;",
        "&#128;&#x99;&#0;&#xD800;&#99999999999;&#1;&#xFFFF;|", "&#0000065&#x00041", "a&nbsp;b", "&NotEqualTilde;&fjlig;", "&Tab;x&NewLine;",
    ]
    pages = make(list(enumerate(texts)), "id int, html string")
    assert as_set(files.html_text(pages, "id", "html"), "id", "text") == {(i, html.unescape(t).strip()) for i, t in enumerate(texts)}
    every = [(i, f"[&{name}]") for i, name in enumerate(html5)]
    assert as_set(files.html_text(make(every, "id int, html string"), "id", "html"), "id", "text") == {(i, html.unescape(t)) for i, t in every}


def test_html_tags_end_outside_quotes_and_script_bodies_are_raw(make):
    rows = [
        ('<a title="a > b">one</a> <img alt=\'x > y\'/>two', "one two", "one two"), ("<p it's>three<p class = \"a>b\" id=c=\"d>four", "three four", "three four"),
        ('x<script type="a>b">if (a<b && c>d) { s = "<i>&eacute;</i>"; }</script>y', 'x if (a<b && c>d) { s = "<i>&eacute;</i>"; } y', "x y"),
        ("<STYLE>a > b {}</style >after<!-- <script> -->shown", "a > b {} after shown", "after shown"), ("<?xml version='1'?><!DOCTYPE html>t<scripted>u</scripted>", "t u", "t u"), ("z<script>open", "z open", "z"),
        ("<p " + " ".join(f'a{i}="{i}>"' for i in range(300)) + ">" + "long " * 20000 + "<script>" + "x<y>" * 20000 + "</script>", ("long " * 20000 + "x<y>" * 20000), ("long " * 20000).strip()),
    ]
    pages = make([(i, page) for i, (page, _, _) in enumerate(rows)], "id int, html string")
    assert as_set(files.html_text(pages, "id", "html"), "id", "text") == {(i, kept) for i, (_, kept, _) in enumerate(rows)}
    assert as_set(files.html_text(pages, "id", "html", drop_script=True), "id", "text") == {(i, shown) for i, (_, _, shown) in enumerate(rows)}


def test_cells_and_sinks(spark, make, tmp_path):
    df = make([(1, "x", 2.5, True), (2, " ", None, False)], "id int, t string, v double, b boolean")
    cells = X.to_cells(df, F.lit("d"), F.lit("s"), F.col("id") + 1, ["t", "v", "b"])
    assert as_set(cells, "row_idx", "header", "value_str", "value_num", "value_kind") == {
        (2, "t", "x", None, "text"), (2, "v", "2.5", 2.5, "number"), (2, "b", "True", None, "bool"), (3, "b", "False", None, "bool"),
    }
    rows = make([("w.xlsx", "S", None, None, "金额", "sum", 651.6)], "doc_name string, sheet string, group_col string, group_value string, column string, metric string, value double")
    out = os.path.join(str(tmp_path), "result")
    assert sinks.write_result_table(rows, out) == ["文档", "工作表", "数值字段", "指标", "结果"]
    assert spark.read.parquet(out).count() == 1


def test_streams_give_the_batch_result(spark, make, tmp_path):
    folder = str(tmp_path / "in")
    docs = make([(i, n, t, "acme") for i, n, t in NOTES], "doc_id int, doc_name string, text string, company string")
    docs.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    counts = jobs.topic_counts(stream, default_rules())
    query = counts.writeStream.outputMode("complete").format("memory").queryName("topics").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = C.topic_coverage(segments(make), default_rules())
    assert as_set(spark.table("topics"), "company", "topic", "evidence", "documents") == as_set(batch, "company", "topic", "evidence", "documents")

    snapshots = str(tmp_path / "snap")
    renamed = stream.withColumn("doc_name", F.lit("same.txt"))
    jobs.upsert_stream(renamed.select("doc_id", "doc_name", "company"), snapshots, str(tmp_path / "cp"), ["doc_name", "company"], "doc_id").awaitTermination(120)
    newest = max(int(n[1:]) for n in os.listdir(snapshots))
    assert as_set(spark.read.parquet(f"{snapshots}/v{newest}"), "doc_id") == {(3,)}


def test_stale_sessions_stream(spark, make, tmp_path):
    folder = str(tmp_path / "ev")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:30:00"), ("c", "2024-01-01 05:00:00")]
    events = make(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    query = jobs.stale_sessions(stream, "k", "ts", "5 minutes", "1 minute").writeStream.outputMode("append").format("memory").queryName("stale").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert as_set(spark.table("stale"), "k", "events") == {("a", 2), ("b", 1)}
    assert as_set(A.stale_keys(events, "k", "ts", F.lit("2024-01-01 01:00:00").cast("timestamp")), "k") == {("a",), ("b",)}


def test_upsert_keeps_place(make):
    old = make([("a", None, 1), ("b", "s", 2)], "name string, source string, seq int")
    new = make([("a", "", 3), ("c", "s", 4)], "name string, source string, seq int")
    assert as_set(A.upsert(old, new, ["name", "source"], "seq"), "name", "seq", "position") == {("a", 3, 1), ("b", 2, 2), ("c", 4, 4)}


def test_places_of_segments_are_searched_and_add_to_the_score(spark, make):
    schema = "doc_name string, doc_type string, kinds array<string>, segments array<string>, places array<struct<section: string, sheet: string, page: int, row_start: int>>"
    places = [("Water use", "S1", 3, None), (None, "", None, 7), None]
    df = make([("d", "text", [], ["one", "two", "three", "four"], places)], schema)
    got = {s["seg_idx"]: s["points"] for s in T.score_documents(df, S.string_array(["zzz"])).collect()[0]["scored"]}
    assert got == {0: 180 + 20 + 40, 1: 172 + 30, 2: 164, 3: 156}
    hit = T.score_documents(df, S.string_array(["water"])).collect()[0]["scored"]
    assert [(s["seg_idx"], s["points"]) for s in hit] == [(0, 180 + 60 + 500)]


def test_counted_kpis_are_those_with_a_number_that_is_no_year(make):
    texts = ["rate 5%", "rate 2020", "rate 2020 and 2021", "rate 2020, then 7 times", "rate 1,950 and 1899", "rate", "5%", "rate 2,100", "rate 2100.5", None, ""]
    rows = [(i, "c", i, i, "d", 0, "s", "l", t) for i, t in enumerate(texts)]
    segments = make(rows, "id long, company string, doc_id long, doc_idx long, doc_name string, seg_idx int, segment_id string, location string, text string").drop("id")
    rules = RuleSet({"p": "P"}, {"p": ["rate"]}, (Topic("t", "T", "p", ("then",), (), ("rate",), 1),), (Kpi("m", "p", ("rate",), ("%",)), Kpi("m", "p", ("rat",), ()), Kpi("n", "p", ("then",), ())))
    for compat in (False, True):
        full = C.segment_facts(segments, rules, compat=compat)
        told = [tuple(r) for r in full.select("doc_id", "kind", "rule", "pillar", "topic").collect()]
        counted = C.segment_facts(segments, rules, compat=compat, values=False)
        assert sorted(map(str, told)) == sorted(str(tuple(r)) for r in counted.select("doc_id", "kind", "rule", "pillar", "topic").collect())
        plan = counted.where("kind = 'kpi'")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and "array_min" not in plan  # no unit and no best number is looked for
    assert [r[0] for r in C.segment_facts(segments, rules, ["kpi"], values=False).where("rule = 'm'").orderBy("doc_id").select("doc_id").collect()] == [0, 3, 4, 8]
