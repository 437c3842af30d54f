"""Profiling of cell grids: header rows, headers, numeric columns, label anchors, value zones, sheet roles.

Input is a `cells` table (doc_id, doc_name, sheet, row_idx, col_idx, value_str, value_num) with one row
per filled cell. Every step is an aggregation with map-side combine, so a sheet of any size costs no
task more than its share; what leaves an aggregation is a few rows per sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators.scaling import attach, number_rows, row_block
from gridweave.rules import fixed

SHEET = ["doc_id", "sheet"]


# --- what a cell looks like -------------------------------------------------------------------


def looks_like_header(text: str) -> Column:
    token = S.norm_token_sql(text)
    return F.expr(f"({token} IN ({S.sql_list(fixed.HEADER_SIGNALS)}) OR startswith({token}, '{fixed.HEADER_SIGNAL_PREFIX}'))")


def looks_like_title(text: str) -> Column:
    token = S.norm_token_sql(text)
    hints = S.contains_any_sql(text, fixed.TITLE_ROW_HINTS)
    return F.expr(f"({token} <> '' AND ({token} IN ({S.sql_list(fixed.SHEET_TEMPLATE_HINTS)}) OR {hints}))")


def metric_of_label(text: str, aliases: dict[str, list[str]] | None = None) -> Column:
    """Metric a label names, NULL if it is not a metric label."""
    table = aliases or fixed.PROFILE_METRIC_ALIASES
    names: dict[str, str] = {}
    for metric, words in table.items():
        for word in [metric, *words]:
            names.setdefault(S.py_token(word), metric)
    return S.lookup(names, S.norm_token_sql(text))


# --- header row -------------------------------------------------------------------------------


def sheet_heads(cells: DataFrame, with_names: bool = True) -> DataFrame:
    """Header row per sheet: place, score, confidence, number of filled cells and, if wanted, header names.

    The first eight rows compete; all later rows matter only as "the next filled row", so they are
    combined into one bucket per sheet. At most nine rows per sheet leave the aggregation, with the cells
    of the eight first rows (bounded by the columns of a sheet).
    """
    limit = fixed.HEADER_SCAN_ROWS
    text, in_scan = "value_str", F.col("row_idx") <= limit
    number_row = F.when(F.col("value_num").isNotNull(), F.col("row_idx"))
    named = F.collect_list(F.when(in_scan, F.struct("col_idx", "value_str"))) if with_names else F.lit(None)
    rows = cells.groupBy(*SHEET, F.least(F.col("row_idx"), F.lit(limit + 1)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("filled"),
        F.count("value_num").alias("numbers"),
        F.sum(F.when(in_scan, looks_like_header(text).cast("int")).otherwise(0)).alias("signals"),
        F.max(F.when(in_scan, looks_like_title(text)).otherwise(False)).alias("title"),
        F.min("row_idx").alias("row"),
        F.min(number_row).alias("number_row"),
        F.max("doc_name").alias("doc_name"),
        F.max("col_idx").alias("width"),
        named.alias("names"),
    )
    after = Window.partitionBy(*SHEET).orderBy("bucket")
    filled, numbers = F.col("filled"), F.col("numbers")
    score = (
        F.least(filled, F.lit(4))
        + 3 * F.least(F.col("signals"), F.lit(3))
        + F.when(filled == 1, -4).otherwise(0)
        + F.when(numbers == 0, 1).when(numbers >= F.greatest(F.lit(1), filled - 1), -3).otherwise(0)
        + F.when(F.col("title") & (filled <= 2), -3).otherwise(0)
        + F.when(F.lead(F.col("number_row") == F.col("row")).over(after), 2).otherwise(0)
    )
    scored = rows.withColumn("score", F.when(F.col("bucket") <= limit, score).otherwise(F.lit(1)))
    best = F.struct((F.col("bucket") <= limit).alias("in_scan"), "score", "signals", "filled", (-F.col("row")).alias("up"))
    heads = scored.groupBy(*SHEET).agg(
        F.max("doc_name").alias("doc_name"), F.max("width").cast("int").alias("width"), F.max(best).alias("b"), F.max_by("names", best).alias("names")
    ).select(
        *SHEET, "doc_name", (-F.col("b.up")).cast("bigint").alias("header_row"), F.col("b.score").cast("int").alias("score"),
        score_confidence(F.col("b.score")).alias("header_confidence"), F.col("b.filled").alias("header_cells"), "width", "names",
    )
    if not with_names:
        return heads.drop("width", "names")
    # Sheets whose first filled row lies below the scanned rows: their header cells are read by address.
    late = heads.where(F.col("header_row") > limit).select(*SHEET, F.col("header_row").cast(cells.schema["row_idx"].dataType).alias("row_idx"))
    late_names = cells.join(late, [*SHEET, "row_idx"]).groupBy(*SHEET).agg(F.collect_list(F.struct("col_idx", "value_str")).alias("late_names"))
    found = heads.join(late_names, SHEET, "left").withColumn("names", F.coalesce("late_names", "names"))
    return found.withColumn("headers", repaired_names(F.map_from_entries("names"), F.col("width"))).drop("width", "names", "late_names")


def detect_header(cells: DataFrame) -> DataFrame:
    """Header row per sheet with its score, confidence and number of filled cells."""
    return sheet_heads(cells, with_names=False)


def score_confidence(score: Column) -> Column:
    return F.when(score >= 9, "high").when(score >= 5, "medium").otherwise("low")


# --- headers and records ----------------------------------------------------------------------


def repaired_names(names: Column, width: Column) -> Column:
    """Names of all columns from the filled header cells: blank ones become `column_i`, repeats `_2`, `_3`, ..."""
    listed = F.transform(
        F.sequence(F.lit(1), width),
        lambda i: F.coalesce(F.try_element_at(names, i), F.concat(F.lit("column_"), i.cast("string"))),
    )

    def add(done: Column, name: Column) -> Column:
        suffixed = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda k: F.concat(name, F.lit("_"), k.cast("string")))
        free = F.element_at(F.filter(suffixed, lambda c: ~F.array_contains(done, c)), 1)
        return F.array_append(done, F.when(F.array_contains(done, name), free).otherwise(name))

    return F.when(F.size(F.array_distinct(listed)) == width, listed).otherwise(F.aggregate(listed, S.string_array([]), add))


def unique_headers(heads: DataFrame) -> DataFrame:
    """Header of every column of a sheet, one row each, from `sheet_heads`."""
    return heads.select(*SHEET, F.posexplode_outer("headers").alias("p", "header")).where("p IS NOT NULL").select(
        *SHEET, (F.col("p") + 1).alias("col_idx"), "header"
    )


def records(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """Cells below the header row with the header of their column; blank rows are not there."""
    data = attach(cells, heads.select(*SHEET, "header_row", "headers"), SHEET, "inner").where("row_idx > header_row")
    return data.withColumn("header", F.element_at("headers", F.col("col_idx").cast("int"))).drop("headers")


def numeric_columns(data: DataFrame) -> DataFrame:
    """Per column: how many cells hold a value and a number; one number makes the column numeric."""
    return data.groupBy(*SHEET, "col_idx", "header").agg(
        F.count("value_str").alias("filled"), F.count("value_num").alias("numbers")
    ).withColumn("is_numeric", F.col("numbers") > 0)


# --- labels and value zones -------------------------------------------------------------------


def label_anchors(cells: DataFrame, heads: DataFrame, area: tuple[int, int] | None = None) -> DataFrame:
    """Metric labels of the whole sheet, or of its first rows and columns if an `area` is given, except in a
    confident header row with two cells or more."""
    area = cells if area is None else cells.where((F.col("row_idx") <= area[0]) & (F.col("col_idx") <= area[1]))
    labelled = area.withColumn("metric", metric_of_label("value_str")).where("metric IS NOT NULL")
    placed = labelled.join(heads.select(*SHEET, "header_row", "header_confidence", "header_cells"), SHEET)
    in_header = (F.col("row_idx") == F.col("header_row")) & F.col("header_confidence").isin("high", "medium") & (F.col("header_cells") >= 2)
    return placed.where(~in_header).select(
        *SHEET, "row_idx", "col_idx", S.a1_encode("row_idx", "col_idx").alias("cell"), F.col("value_str").alias("label"), "metric"
    )


def value_zones(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per label the first three places for its value: right 1 to 3, then down 1 to 2.

    Places whose cell is a header, title or label itself are skipped. Only such cells take part in the
    join, so what is shuffled is a small part of the grid.
    """
    places = F.array(
        *[
            F.struct(F.lit(i).alias("o"), F.lit(d).alias("direction"), F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(n).alias("distance"))
            for i, (d, r, c, n, *_) in enumerate(fixed.VALUE_POSITIONS)
        ]
    )
    wanted = anchors.select(
        *SHEET, F.col("cell").alias("anchor_cell"), "metric", F.explode(places).alias("p"), "row_idx", "col_idx"
    ).select(
        *SHEET, "anchor_cell", "metric", "p.o", "p.direction", "p.distance",
        (F.col("row_idx") + F.col("p.dr")).alias("row_idx"), (F.col("col_idx") + F.col("p.dc")).alias("col_idx"),
    )
    text = "value_str"
    taken = cells.where(looks_like_header(text) | looks_like_title(text) | metric_of_label(text).isNotNull()).select(*SHEET, "row_idx", "col_idx")
    free = wanted.join(taken, [*SHEET, "row_idx", "col_idx"], "left_anti")
    nearest = Window.partitionBy(*SHEET, "anchor_cell").orderBy("o")
    return free.withColumn("n", F.row_number().over(nearest)).where("n <= 3").select(
        *SHEET, "anchor_cell", "metric", S.a1_encode("row_idx", "col_idx").alias("cell"), "row_idx", "col_idx", "direction", "distance"
    )


# --- sheet profile ----------------------------------------------------------------------------


def sheet_profile(cells: DataFrame) -> DataFrame:
    """One row per sheet: header, columns, row count, anchors, zones, role and layout summary."""
    heads = sheet_heads(cells)
    data = records(cells, heads)
    anchors = label_anchors(cells, heads)
    zones = value_zones(cells, anchors)
    numeric = (
        data.groupBy(*SHEET, "col_idx").agg(F.count("value_num").alias("numbers")).where("numbers > 0")
        .groupBy(*SHEET).agg(F.sort_array(F.collect_list("col_idx")).alias("numeric_idx"))
    )
    row_counts = data.groupBy(*SHEET).agg(F.count_distinct("row_idx").alias("row_count"))
    marks = (
        anchors.select(*SHEET, F.lit(1).alias("a"), F.lit(0).alias("z")).unionByName(zones.select(*SHEET, F.lit(0).alias("a"), F.lit(1).alias("z")))
        .groupBy(*SHEET).agg(F.sum("a").alias("anchors"), F.sum("z").alias("zones"))
    )
    joined = heads.join(numeric, SHEET, "left").join(row_counts, SHEET, "left").join(marks, SHEET, "left")
    profile = joined.na.fill(0, ["row_count", "anchors", "zones"]).select(
        *SHEET, "doc_name", "header_row", "header_confidence", "row_count", "anchors", "zones", "headers",
        F.coalesce(
            F.transform("numeric_idx", lambda i: F.element_at("headers", i.cast("int"))), S.string_array([])
        ).alias("numeric_columns"),
    ).withColumn("sheet_role", sheet_role())
    return profile.withColumn("layout_summary", layout_summary())


def sheet_role() -> Column:
    """template_like, source_like or unknown, from the columns of a sheet profile."""
    tokens = F.transform("headers", S.norm_token)
    metric, result = F.array_contains(tokens, fixed.METRIC_HEADER), F.array_contains(tokens, fixed.RESULT_HEADER)
    numeric = F.size("numeric_columns")
    template = (
        F.when(metric & result, 5).when(metric | result, 3).otherwise(0)
        + F.least(F.col("anchors"), F.lit(3)) * 2
        + F.when(F.col("row_count") <= 3, 1).otherwise(0)
        + F.when(S.contains_any("lower(sheet)", fixed.SHEET_TEMPLATE_HINTS), 2).otherwise(0)
    )
    source = (
        F.when(numeric > 0, F.least(numeric, F.lit(2)) + 4).otherwise(0)
        + F.when(F.col("row_count") >= 5, 2).otherwise(0)
        + F.when(F.arrays_overlap(tokens, S.string_array(fixed.SOURCE_HEADER_TOKENS)), 1).otherwise(0)
    )
    return F.when(template >= source + 2, "template_like").when(source >= template + 1, "source_like").otherwise("unknown")


def layout_summary() -> Column:
    """Header row, role and counts of a sheet profile in words."""
    before, row_end, confidence_end, role, stop, found, anchors, zones = (F.lit(t) for t in fixed.LAYOUT_SUMMARY)
    number = lambda c: F.col(c).cast("string")
    return F.concat(before, number("header_row"), row_end, F.col("header_confidence"), confidence_end, role, F.col("sheet_role"), stop, found, number("anchors"), anchors, number("zones"), zones)


# --- rows as text -----------------------------------------------------------------------------


def row_blocks(data: DataFrame) -> DataFrame:
    """Blocks of eight data rows as text, with their row range. Rows are counted from the header on."""
    cell = F.struct("col_idx", F.concat("header", F.lit("="), "value_str").alias("text"))
    lines = data.groupBy(*SHEET, "row_idx").agg(
        F.max("header_row").alias("header_row"),
        F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["text"]), "；").alias("cells"),
    )
    numbered = number_rows(lines, SHEET, [F.col("row_idx")], row_block("row_idx"), "n")
    row_no = F.col("header_row") + F.col("n")
    texts = numbered.select(
        *SHEET, F.floor((F.col("n") - 1) / fixed.ROW_BLOCK_SIZE).alias("block"), row_no.alias("row_no"),
        F.concat(F.lit("第 "), row_no.cast("string"), F.lit(" 行："), "cells").alias("line"),
    )
    blocks = texts.groupBy(*SHEET, "block").agg(
        F.min("row_no").alias("row_start"), F.max("row_no").alias("row_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"]), "\n").alias("text"),
    )
    return blocks.select(
        *SHEET, (F.col("block") + 1).alias("seg_idx"), F.lit("table_row_block").alias("kind"),
        F.concat("sheet", F.lit(" 行 "), F.col("row_start").cast("string"), F.lit("-"), F.col("row_end").cast("string")).alias("label"),
        "text", "row_start", "row_end",
    )


def sheet_summary(profile: DataFrame) -> DataFrame:
    """The summary segment of each sheet: title, first eight headers, row count, layout."""
    return profile.where(F.size("headers") > 0).select(
        *SHEET, F.lit("sheet_summary").alias("kind"), F.concat("sheet", F.lit(" 概览")).alias("label"),
        F.concat(
            F.lit("工作表 "), "sheet", F.lit("。表头："), F.array_join(F.slice("headers", 1, 8), "、"), F.lit("。数据行数："),
            F.col("row_count").cast("string"), F.lit("。"), "layout_summary",
        ).alias("text"),
    )


def structured_summary(profile: DataFrame, sheets_shown: int = 3, headers_shown: int = 6) -> DataFrame:
    """Per document: number of sheets, and headers and row count of the first sheets (by `sheet_order` or name)."""
    order = F.col("sheet_order") if "sheet_order" in profile.columns else F.col("sheet")
    headers = F.coalesce(F.nullif(F.array_join(F.slice("headers", 1, headers_shown), "、"), F.lit("")), F.lit("未识别"))
    line = F.concat(
        F.lit("工作表 "), "sheet", F.lit("：表头 "), headers, F.lit("，共 "), F.col("row_count").cast("string"), F.lit(" 行数据。")
    )
    first = Window.partitionBy("doc_id").orderBy(order)
    counts = profile.groupBy("doc_id").agg(F.max("doc_name").alias("doc_name"), F.count(F.lit(1)).alias("sheets"))
    shown = (
        profile.select("doc_id", F.row_number().over(first).alias("n"), line.alias("line")).where(f"n <= {sheets_shown}")
        .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    )
    return counts.join(shown, "doc_id").select(
        "doc_id", "sheets",
        F.concat(
            "doc_name", F.lit(" 已包含 "), F.col("sheets").cast("string"), F.lit(" 个工作表的结构化数据。\n"),
            F.array_join(F.transform("ls", lambda x: x["line"]), "\n"),
        ).alias("summary"),
    )
