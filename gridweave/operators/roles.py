"""Roles of workbooks in a fill request: source or template, by scores; choice of tables, documents and sheets.

`profile` is the output of `sheet_profile`. `requests` holds one row per request and document:
request_id, request, doc_id, doc_name, doc_idx (the order of the documents in the request).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators.scaling import attach
from gridweave.rules import fixed


def hint_count(text_lower: str, hints: Sequence[str]) -> Column:
    return F.expr("(" + " + ".join(f"cast(contains({text_lower}, {S.sql_text(h)}) as int)" for h in hints) + ")")


def stem(name_lower: Column) -> Column:
    return F.regexp_replace(name_lower, r"\.[^.]*$", "")


def is_mentioned(request_lower: Column, name_lower: Column) -> Column:
    """Does the request name the document, with or without its suffix?"""
    base = stem(name_lower)
    return (name_lower != "") & (
        F.contains(request_lower, name_lower) | ((base != "") & F.contains(request_lower, base))
    )


def has_metric_result_headers(headers: Column) -> Column:
    """Are both a metric header and a result header there?"""
    names = F.transform(headers, lambda h: F.lower(S.strip(h)))
    return F.arrays_overlap(names, S.string_array(fixed.METRIC_HEADER_NAMES)) & F.arrays_overlap(
        names, S.string_array(fixed.RESULT_HEADER_NAMES)
    )


def _if(condition: Column, points: Column | int) -> Column:
    return F.when(condition, points).otherwise(0)


def document_scores(profile: DataFrame) -> DataFrame:
    """Source and template points of the sheets of each document, independent of any request."""
    title, rows = F.lower("sheet"), F.col("row_count")
    numeric = F.size("numeric_columns") > 0
    source = (
        _if(F.col("sheet_role") == "source_like", 4)
        + _if((rows > 0) & numeric, F.when(rows >= 5, 5).otherwise(3))
        + _if(S.contains_any("lower(sheet)", fixed.ROLE_SOURCE_SHEET_HINTS), 2)
    )
    template = (
        _if(F.col("sheet_role") == "template_like", 4)
        + _if(S.contains_any("lower(sheet)", fixed.ROLE_TEMPLATE_SHEET_HINTS), 2)
        + _if(has_metric_result_headers(F.col("headers")), 5)
        + F.least(F.col("anchors"), F.lit(3)) * 2
        + F.least(F.col("zones"), F.lit(3))
        + _if((rows <= 3) & ~numeric, 1)
    )
    return profile.groupBy("doc_id").agg(F.sum(source).alias("source_points"), F.sum(template).alias("template_points"))


def role_scores(requests: DataFrame, profile: DataFrame) -> DataFrame:
    """Source score, template score and confidence of each document in each request."""
    name, request = F.lower("doc_name"), F.lower("request")
    scored = requests.join(document_scores(profile), "doc_id", "left").na.fill(0, ["source_points", "template_points"])
    named = scored.withColumn("mentioned", is_mentioned(request, name))
    twice = F.when(F.col("mentioned"), 2).otherwise(0)
    points = named.withColumn(
        "source_score", (F.col("source_points") + twice + 3 * hint_count("lower(doc_name)", fixed.ROLE_SOURCE_HINTS)).cast("int")
    ).withColumn(
        "template_score", (F.col("template_points") + twice + 3 * hint_count("lower(doc_name)", fixed.ROLE_TEMPLATE_HINTS)).cast("int")
    )
    gap = F.abs(F.col("source_score") - F.col("template_score"))
    confidence = (
        F.when((F.col("source_score") > 0) & (F.col("template_score") > 0) & (gap <= 2), "medium")
        .when(gap >= 5, "high").when(gap >= 2, "medium").otherwise("low")
    )
    return points.withColumn("confidence", confidence).drop("source_points", "template_points")


def select_roles(scores: DataFrame) -> DataFrame:
    """Role of each document: source, template, source_and_template or unselected.

    Named documents with five points or more win; else those with points that are not below the other
    score; else the best one. For the template the fallback prefers documents below the best source.
    """
    source, template = F.col("source_score"), F.col("template_score")
    named_source, named_template = F.col("mentioned") & (source >= 5), F.col("mentioned") & (template >= 5)
    fit_source, fit_template = (source > 0) & (source >= template), (template > 0) & (template >= source)
    # First per source score (there are few), then per request: the best template below the top source
    # needs the top source, and this way the scores are read once for all facts.
    late = (-F.col("doc_idx")).alias("late")
    levels = scores.groupBy("request_id", "source_score").agg(
        F.count(F.lit(1)).alias("documents"), F.max(F.struct(template, late, "doc_id")).alias("best_template"), F.max(F.struct(late, "doc_id")).alias("first"),
        F.bool_or(named_source).alias("ns"), F.bool_or(named_template).alias("nt"), F.bool_or(fit_source).alias("fs"), F.bool_or(fit_template).alias("ft"),
    )
    facts = levels.groupBy("request_id").agg(
        F.sum("documents").alias("documents"), F.bool_or("ns").alias("any_named_source"), F.bool_or("nt").alias("any_named_template"),
        F.bool_or("fs").alias("any_fit_source"), F.bool_or("ft").alias("any_fit_template"),
        F.max_by("first.doc_id", "source_score").alias("best_source"),
        F.sort_array(F.collect_list(F.struct("source_score", "best_template"))).alias("ranks"),
    )
    below = F.expr("CASE WHEN size(ranks) > 1 THEN array_max(transform(slice(ranks, 1, size(ranks) - 1), r -> r.best_template)) ELSE ranks[0].best_template END")
    facts = facts.withColumn("best_template", below["doc_id"]).drop("ranks")
    full = attach(scores, facts, ["request_id"], "inner")

    def chosen(kind: str, named: Column, fit: Column) -> Column:
        rule = F.when(F.col(f"any_named_{kind}"), named).when(F.col(f"any_fit_{kind}"), fit)
        return (F.col("documents") == 1) | rule.otherwise(F.col("doc_id") == F.col(f"best_{kind}"))

    picked = full.withColumn("is_source", chosen("source", named_source, fit_source)).withColumn(
        "is_template", chosen("template", named_template, fit_template)
    )
    role = (
        F.when(F.col("is_source") & F.col("is_template"), "source_and_template")
        .when(F.col("is_template"), "template").when(F.col("is_source"), "source").otherwise("unselected")
    )
    return picked.select(*scores.columns, "documents", "is_source", "is_template", role.alias("role"))


def role_warnings(roles: DataFrame) -> DataFrame:
    """Warnings per request: overlap of the roles, low confidence."""
    overlap = F.bool_or(F.col("is_source") & F.col("is_template") & (F.col("documents") > 1))
    return roles.groupBy("request_id").agg(
        F.array_compact(
            F.array(
                F.when(~F.bool_or("is_source"), fixed.ROLE_WARNINGS["no_source"]),
                F.when(~F.bool_or("is_template"), fixed.ROLE_WARNINGS["no_template"]),
                F.when(overlap, fixed.ROLE_WARNINGS["overlap"]),
                F.when(F.bool_or(F.col("confidence") == "low"), fixed.ROLE_WARNINGS["low"]),
            )
        ).alias("warnings")
    )


def documents_with_role(documents: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """Documents of a request that have a role (`source` or `template`)."""
    return documents.join(roles.where(f"is_{role}").select("request_id", "doc_id"), ["request_id", "doc_id"], "left_semi")


def calculation_sources(requests: DataFrame, profile: DataFrame) -> DataFrame:
    """Documents to calculate from when no roles are known; the same idea with another set of points."""
    sheets = profile.withColumn("h", F.explode_outer("headers"))
    request = F.lower("request")
    header_hit = F.contains(request, F.lower(S.strip("h"))) & (S.strip("h") != "")
    canonical = S.header_alias("h")
    for name, words in fixed.CALC_HEADER_ALIASES.items():
        header_hit = header_hit | ((canonical == name) & S.contains_any("lower(request)", words))
    hits = (
        requests.select("request_id", "request", "doc_id").join(sheets.select("doc_id", "sheet", "h"), "doc_id")
        .groupBy("request_id", "doc_id", "sheet").agg(F.coalesce(F.bool_or(header_hit), F.lit(False)).alias("hit"))
    )
    rows, numeric = F.col("row_count"), F.size("numeric_columns")
    lowered = F.transform("headers", lambda h: F.lower(S.strip(h)))
    both = F.arrays_overlap(lowered, S.string_array(fixed.METRIC_HEADER_NAMES)) & F.arrays_overlap(lowered, S.string_array(fixed.RESULT_HEADER_NAMES))
    source = (
        _if((rows > 0) & (numeric > 0), F.when(rows >= 5, 4).otherwise(2)) + _if(rows >= 5, 1)
        + _if(F.size("headers") >= 2, 1) + _if(F.col("hit"), 2)
    )
    template = (
        _if(S.contains_any("lower(sheet)", fixed.ROLE_TEMPLATE_SHEET_HINTS), 2) + _if(both, 4)
        + _if((rows <= 3) & (numeric <= 1), F.when(F.col("hit"), 1).otherwise(3))
    )
    points = hits.join(profile, ["doc_id", "sheet"]).groupBy("request_id", "doc_id").agg(
        F.sum(source).alias("sp"), F.sum(template).alias("tp")
    )
    name = F.lower("doc_name")
    mentioned = is_mentioned(request, name)
    scored = requests.join(points, ["request_id", "doc_id"], "left").na.fill(0, ["sp", "tp"]).select(
        *requests.columns, mentioned.alias("mentioned"),
        (F.col("sp") + F.when(mentioned, 5).otherwise(0) + 4 * hint_count("lower(doc_name)", fixed.CALC_SOURCE_HINTS)).cast("int").alias("source_score"),
        (F.col("tp") + 3 * hint_count("lower(doc_name)", fixed.CALC_TEMPLATE_HINTS)).cast("int").alias("template_score"),
    )
    any_named = attach(
        scored, scored.groupBy("request_id").agg(F.bool_or("mentioned").alias("any_named")), ["request_id"], "inner"
    ).where("mentioned OR NOT any_named")
    better = F.col("source_score") > F.col("template_score")
    not_template = (F.col("template_score") == 0) | (F.col("source_score") >= F.col("template_score"))
    facts = any_named.groupBy("request_id").agg(
        F.bool_or(better).alias("any_better"), F.bool_or(not_template).alias("any_plain"), F.count(F.lit(1)).alias("n")
    )
    keep = F.when(F.col("any_better"), better).when((F.col("n") > 1) & F.col("any_plain"), not_template).otherwise(True)
    return attach(any_named, facts, ["request_id"], "inner").where(keep).drop("any_named", "any_better", "any_plain", "n")


def best_source_table(requests: DataFrame, profile: DataFrame) -> DataFrame:
    """The table to transfer from: most rows plus twice the number columns, five more if source-like."""
    score = F.col("row_count") + 2 * F.size("numeric_columns") + F.when(F.col("sheet_role") == "source_like", 5).otherwise(0)
    tables = profile.where((F.size("headers") > 0) & (F.col("row_count") > 0)).select("doc_id", "sheet", score.alias("score"))
    rank = F.struct("score", (-F.col("doc_idx")).alias("x"))
    return requests.join(tables, "doc_id").groupBy("request_id").agg(
        F.max_by(F.struct("doc_id", "sheet", "score"), rank).alias("b")
    ).select("request_id", "b.*")


def template_structure(profile: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """Best template points of the sheets of each document.

    `waiting` (doc_id, sheet) lists sheets with a metric row whose result is blank.
    """
    def names(canonical: str) -> Column:
        words = S.string_array([w.lower() for w in fixed.FILL_HEADER_ALIASES[canonical]])
        return F.arrays_overlap(F.transform("headers", lambda h: F.lower(S.strip(h))), words)

    metric, result = names("指标"), names("结果")
    score = (
        _if(S.contains_any("lower(sheet)", fixed.ROLE_TEMPLATE_SHEET_HINTS), 2)
        + F.when(metric & result, 5).when(result, 3).when(metric, 2).otherwise(0)
        + F.when(F.col("sheet_role") == "template_like", 3).when(F.col("sheet_role") == "source_like", -2).otherwise(0)
        + F.when(F.col("header_confidence") == "high", 1).when(F.col("header_confidence") == "low", -1).otherwise(0)
        + F.least(F.col("anchors"), F.lit(3)) * 2 + F.least(F.col("zones"), F.lit(3))
        + _if(names("数值字段") | names("工作表") | names("文档"), 1)
    )
    sheets = profile
    if waiting is not None:
        sheets = sheets.join(waiting.select("doc_id", "sheet").distinct().withColumn("waits", F.lit(True)), ["doc_id", "sheet"], "left")
        score = score + _if(metric & result & F.coalesce("waits", F.lit(False)), 2)
    return sheets.groupBy("doc_id").agg(F.greatest(F.max(score), F.lit(0)).alias("structure"))


def target_document(requests: DataFrame, profile: DataFrame, sources: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """The document to fill per request. `sources` (request_id, doc_name): documents the results come from.

    The best score wins, a tie goes to the later document. With no score above zero the only document
    that is no source is taken, else the first source document, else the first document.
    """
    name, request = F.lower(S.strip("doc_name")), F.lower("request")
    known = requests.join(sources.select("request_id", "doc_name").distinct().withColumn("is_source", F.lit(True)), ["request_id", "doc_name"], "left")
    scored = known.join(template_structure(profile, waiting), "doc_id", "left").na.fill(0, ["structure"]).na.fill(False, ["is_source"])
    score = (
        F.when((name != "") & F.contains(request, name), 8).when((stem(name) != "") & F.contains(request, stem(name)), 6).otherwise(0)
        + 3 * hint_count("lower(doc_name)", fixed.ROLE_TEMPLATE_HINTS) - 2 * hint_count("lower(doc_name)", fixed.ROLE_SOURCE_HINTS) + F.col("structure")
        + F.when(F.col("is_source"), -2).otherwise(2)
    )
    item = F.struct(score.alias("score"), "doc_idx", "doc_id")
    first = F.struct((~F.col("is_source")).alias("other"), "doc_idx", "doc_id")
    best = scored.groupBy("request_id").agg(
        F.max(item).alias("best"), F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("is_source")).alias("others"),
        F.min(F.when(~F.col("is_source"), first)).alias("other"), F.min(first).alias("first"),
    )
    chosen = F.when((F.col("n") == 1) | (F.col("best.score") > 0), F.col("best.doc_id")).when(
        F.col("others") == 1, F.col("other.doc_id")
    ).otherwise(F.col("first.doc_id"))
    return best.select("request_id", chosen.alias("doc_id"), F.col("best.score").cast("int").alias("best_score"))


def transfer_header(cells: DataFrame) -> DataFrame:
    """Header row of a transfer target: the fullest of the first eight rows, two cells at least, first one on a tie."""
    rows = cells.where(F.col("row_idx") <= fixed.HEADER_SCAN_ROWS).groupBy("doc_id", "sheet", "row_idx").agg(F.count(F.lit(1)).alias("filled"))
    return rows.where("filled >= 2").groupBy("doc_id", "sheet").agg(
        F.max_by("row_idx", F.struct("filled", (-F.col("row_idx")).alias("x"))).alias("header_row")
    )


def fill_header(cells: DataFrame, scan_rows: int = 6) -> DataFrame:
    """Header row of a fill template: best alias score of the first six rows, else row 1 if it has cells.

    Result: doc_id, sheet, header_row, layout_score and the column of each known header.
    """
    names = {w.lower(): c for c, ws in fixed.FILL_HEADER_ALIASES.items() for w in ws}
    known = F.when(F.col("row_idx") <= scan_rows, S.lookup(names, F.lower(S.strip("value_str"))))
    positions = {c: F.min(F.when(F.col("known") == c, F.col("col_idx"))) for c in fixed.FILL_HEADER_ALIASES}
    rows = (
        cells.where(F.col("row_idx") <= scan_rows).withColumn("known", known).groupBy("doc_id", "sheet", "row_idx")
        .agg(*[p.alias(c) for c, p in positions.items()])
    )
    score = sum((_if(F.col(c).isNotNull(), w) for c, w in fixed.FILL_HEADER_WEIGHTS.items()), F.lit(0))
    scored = rows.withColumn("score", score).where("score > 0 OR row_idx = 1")
    best = Window.partitionBy("doc_id", "sheet").orderBy(F.col("score").desc(), "row_idx")
    return scored.withColumn("n", F.row_number().over(best)).where("n = 1").select(
        "doc_id", "sheet", F.col("row_idx").alias("header_row"), F.col("score").alias("layout_score"),
        *[F.col(c).alias(e) for c, e in HEADER_COLUMNS.items()],
    )


# Known header -> name of the column that holds its position.
HEADER_COLUMNS = {
    "指标": "metric_col", "结果": "result_col", "文档": "doc_col", "工作表": "sheet_col", "数值字段": "column_col",
    "分组字段": "group_col_col", "分组值": "group_value_col",
}


def target_sheet(layouts: DataFrame, label_matches: DataFrame, requests: DataFrame) -> DataFrame:
    """The sheet to fill per request and document, NULL-free; sheets without any evidence are not returned.

    `layouts`: output of `fill_header`. `label_matches`: doc_id, sheet, labels (number of labels matched).
    """
    title = F.lower("sheet")
    metric, result = F.col("metric_col").isNotNull(), F.col("result_col").isNotNull()
    score = (
        F.when(metric & result, 5).when(result, 3).when(metric, 2).otherwise(0)
        + _if(F.col("column_col").isNotNull() | F.col("sheet_col").isNotNull() | F.col("doc_col").isNotNull(), 1)
        + _if(S.contains_any("lower(sheet)", fixed.ROLE_TEMPLATE_SHEET_HINTS), 2)
        + _if((title != "") & F.contains(F.lower("request"), title), 2)
        + F.least(F.coalesce("labels", F.lit(0)), F.lit(3)) * 2
    )
    scored = layouts.join(label_matches, ["doc_id", "sheet"], "left").join(requests.select("request_id", "request", "doc_id"), "doc_id")
    best = Window.partitionBy("request_id", "doc_id").orderBy(F.col("score").desc(), "sheet")
    return scored.withColumn("score", score).where("score > 0").withColumn("n", F.row_number().over(best)).where("n = 1").select(
        "request_id", "doc_id", "sheet", F.col("score").cast("int").alias("score"),
        F.when(result, "header_layout").otherwise("label_value").alias("mode"),
    )
