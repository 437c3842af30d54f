"""Metrics over sheets: filters, basic, grouped and special metrics, planned calculations, result rows.

Sheets come in two forms. `wide`: one schema, sheet keys and value columns of one DataFrame; all
metrics of all columns are one hash aggregation. `values`: long rows (doc_id, doc_name, sheet, row_idx,
column, col_idx, group_value, value) for sheets whose schemas differ.

Filters with "if nothing matches, keep all" do not filter rows before the aggregation: the aggregation
computes both answers, over the matching rows and over all rows, and picks one per sheet. That needs no
window over the sheet and no second pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators import exact
from gridweave.operators.scaling import attach
from gridweave.rules import fixed

BASIC = ["sum", "avg", "max", "min", "count"]


# --- filters ----------------------------------------------------------------------------------


def row_hit(columns: Sequence[Column], tokens: Sequence[str]) -> Column:
    """Does any cell of a wide row hold any of the tokens, case-folded?"""
    hit = F.lit(False)
    for column in columns:
        text = F.lower(F.coalesce(column.cast("string"), F.lit("")))
        for token in tokens:
            hit = hit | F.contains(text, F.lit(token.lower()))
    return hit


def time_filter(df: DataFrame, sheet_keys: Sequence[str], row_key: str, hit: Column) -> DataFrame:
    """Rows that hit; a sheet without any hit keeps all its rows."""
    marked = df.withColumn("__hit", hit)
    sheets = marked.groupBy(*sheet_keys).agg(F.max("__hit").alias("__any_hit"))
    return attach(marked, sheets, sheet_keys).where("__hit OR NOT __any_hit").drop("__hit", "__any_hit")


def select_columns(sheet_columns: DataFrame, requests: DataFrame) -> DataFrame:
    """Numeric columns a request names (by header or by alias), else all numeric columns of the sheet.

    `sheet_columns`: doc_id, sheet, col_idx, header, is_numeric. `requests`: request_id, doc_id, request.
    """
    numeric = sheet_columns.where("is_numeric")
    named = _named(numeric.join(requests, "doc_id"))
    return (
        named.withColumn("__any", F.max("named").over(Window.partitionBy("request_id", "doc_id", "sheet")))
        .where("named OR NOT __any")
        .drop("__any", "named")
    )


def group_column(sheet_columns: DataFrame, requests: DataFrame) -> DataFrame:
    """First non-numeric header of a sheet that the request names."""
    named = _named(sheet_columns.where("NOT is_numeric").join(requests, "doc_id")).where("named")
    return named.groupBy("request_id", "doc_id", "sheet").agg(F.min_by("header", "col_idx").alias("group_col"))


def _named(columns: DataFrame) -> DataFrame:
    request, header = F.lower("request"), F.lower(S.strip("header"))
    by_alias = F.lit(False)
    canonical = S.header_alias("header")
    for name, words in fixed.CALC_HEADER_ALIASES.items():
        by_alias = by_alias | ((canonical == name) & S.contains_any("lower(request)", words))
    return columns.withColumn("named", ((header != "") & F.contains(request, header)) | by_alias)


# --- wide metrics -----------------------------------------------------------------------------


def _basic(value: Column, scale: int | None, when: Column | None = None) -> dict[str, Column]:
    chosen = value if when is None else F.when(when, value)
    return {
        "sum": S.exact_sum(chosen, scale),
        "max": F.max(chosen),
        "min": F.min(chosen),
        "count": F.count(chosen),
    }


def wide_metrics(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    operations: Sequence[str],
    hit: Column | None = None,
    denominators: Sequence[str] | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Basic metrics, ratio and intensity of several columns per key, as long rows (keys, column, metric, value).

    `hit` marks the rows of a time filter; keys without a hit use all rows. NULL values are skipped and
    the count is that of values. `ratio` is the share of a column in the total of all columns of the
    key; `intensity` divides by the first other column of a denominator kind with a non-zero sum. The
    whole query is one hash aggregation with map-side combine.
    """
    aggregates: list[Column] = []
    for i, value in enumerate(values.values()):
        for name, expression in _basic(value, scale).items():
            aggregates.append(expression.alias(f"__all_{i}_{name}"))
        if hit is not None:
            for name, expression in _basic(value, scale, hit).items():
                aggregates.append(expression.alias(f"__hit_{i}_{name}"))
    if hit is not None:
        aggregates.append(F.max(hit).alias("__any_hit"))
    table = df.groupBy(*keys).agg(*aggregates)

    def measure(i: int, name: str) -> Column:
        everything = F.col(f"__all_{i}_{name}")
        return everything if hit is None else F.when(F.col("__any_hit"), F.col(f"__hit_{i}_{name}")).otherwise(everything)

    names = list(values)
    total = sum((F.coalesce(measure(i, "sum"), F.lit(0.0)) for i in range(1, len(names))), F.coalesce(measure(0, "sum"), F.lit(0.0)))
    kinds = set(denominators if denominators is not None else fixed.INTENSITY_DENOMINATORS)
    alias_of = {w.lower(): c for c, ws in fixed.CALC_HEADER_ALIASES.items() for w in [c, *ws]}

    def metric(i: int, name: str) -> Column:
        if name == "avg":
            return measure(i, "sum") / measure(i, "count")
        if name == "ratio":
            return F.when(total != 0, measure(i, "sum") / total) if len(names) > 1 else F.lit(None).cast("double")
        if name == "intensity":
            base = F.coalesce(
                F.lit(None).cast("double"),
                *[
                    F.when(measure(j, "sum") != 0, measure(j, "sum"))
                    for j, header in enumerate(names)
                    if j != i and (alias_of.get(header.lower(), header.lower()) in kinds or header in kinds)
                ],
            )
            return measure(i, "sum") / base
        return measure(i, name).cast("double")

    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(header).alias("column"), F.lit(op).alias("metric"), metric(i, op).alias("value"))
                for i, header in enumerate(names)
                for op in operations
                if op in BASIC or op in ("ratio", "intensity")
            ]
        )
    )
    return table.select(*keys, rows.alias("__m")).select(*keys, "__m.*").where("value IS NOT NULL")


def group_label(group: Column | str) -> Column:
    """Group value as text; NULL and empty text share one group."""
    column = F.col(group) if isinstance(group, str) else group
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(fixed.EMPTY_GROUP))


def time_column(headers: Sequence[str]) -> str | None:
    """The first header that is a month or a year, by itself or by an alias."""
    alias_of = {w.lower(): c for c, ws in fixed.CALC_HEADER_ALIASES.items() for w in [c, *ws]}
    return next((h for h in headers if alias_of.get(h.strip().lower(), h.strip().lower()) in fixed.TIME_HEADERS), None)


def trend(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], order: str, time: Column | None, operations: Sequence[str]
) -> DataFrame:
    """Change of the last value against the one before, in row order, over rows that have a time value.

    Where `time` is None the time column is the first month or year header of `df` that is no value column; a sheet
    without one has no trend.

    yoy and mom are the same number. Only the last two rows per key and column leave the map side:
    `row_number <= 2` becomes a group limit below the shuffle.
    """
    if time is None:
        header = time_column([c for c in df.columns if c not in values])
        time = F.lit(None).cast("string") if header is None else F.col(f"`{header}`")
    long = (
        df.where(time.isNotNull() & (time.cast("string") != ""))
        .select(
            *keys,
            order,
            F.explode(
                F.array(*[F.struct(F.lit(n).alias("column"), v.cast("double").alias("v")) for n, v in values.items()])
            ).alias("__c"),
        )
        .select(*keys, order, "__c.*")
        .where("v IS NOT NULL")
    )
    recent = Window.partitionBy(*keys, "column").orderBy(F.col(order).desc())
    last_two = long.withColumn("__n", F.row_number().over(recent)).where("__n <= 2")
    pair = last_two.groupBy(*keys, "column").agg(
        F.max(F.when(F.col("__n") == 1, F.col("v"))).alias("last"),
        F.max(F.when(F.col("__n") == 2, F.col("v"))).alias("previous"),
    )
    change = (F.col("last") - F.col("previous")) / F.abs("previous")
    wanted = [op for op in operations if op in ("yoy", "mom")]
    return (
        pair.where("previous IS NOT NULL AND previous <> 0")
        .withColumn("metric", F.explode(S.string_array(wanted)))
        .select(*keys, "column", "metric", change.alias("value"))
    )


# --- long metrics -----------------------------------------------------------------------------


def cell_values(cells: DataFrame, headers: DataFrame, header_rows: DataFrame, group_cols: DataFrame | None = None) -> DataFrame:
    """Long values from cells: numeric cells below the header row, with the group value of their row.

    `headers`: doc_id, sheet, col_idx, header. `header_rows`: doc_id, sheet, header_row.
    `group_cols`: doc_id, sheet, group_col (header name), optional.
    """
    data = attach(cells, header_rows, ["doc_id", "sheet"], "inner").where("row_idx > header_row")
    named = attach(data, headers, ["doc_id", "sheet", "col_idx"], "inner")
    numbers = named.where("value_num IS NOT NULL").select(
        "doc_id", "doc_name", "sheet", "row_idx", "col_idx", F.col("header").alias("column"), F.col("value_num").alias("value")
    )
    if group_cols is None:
        return numbers.withColumn("group_value", F.lit(None).cast("string"))
    groups = attach(named, group_cols, ["doc_id", "sheet"], "inner").where("header = group_col")
    groups = groups.select("doc_id", "sheet", "row_idx", F.col("value_str").alias("__g"))
    return numbers.join(groups, ["doc_id", "sheet", "row_idx"], "left").withColumn("group_value", group_label("__g")).drop("__g")


def value_metrics(values: DataFrame, keys: Sequence[str], scale: int | None = None) -> DataFrame:
    """One row per key with sum, avg, max, min, count and the row range of the values used."""
    return (
        values.groupBy(*keys)
        .agg(
            S.exact_sum("value", scale).alias("sum"),
            F.max("value").alias("max"),
            F.min("value").alias("min"),
            F.count("value").alias("count"),
            F.min("row_idx").alias("row_start"),
            F.max("row_idx").alias("row_end"),
        )
        .where("count > 0")
        .withColumn("avg", F.col("sum") / F.col("count"))
    )


def reproducible_metrics(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`value_metrics` for values of any size and number of decimals, with the same bits for any order and partitions of rows."""
    table = exact.sums(values, keys, "value", least={"min": "value", "row_start": "row_idx"}, most={"max": "value", "row_end": "row_idx"})
    return table.where("count > 0").withColumn("avg", F.col("sum") / F.col("count"))


def cross_sheet(values: DataFrame, scale: int | None = None) -> DataFrame:
    """Metrics per document and column over all its sheets, share of the document total, sheet names.

    Values are combined per sheet first, so the list of names is built from one row per sheet.
    """
    number = F.sum(F.col("value").cast("double")) if scale is None else S.unit_sum("value", scale)
    as_double = (lambda c: F.col(c)) if scale is None else (lambda c: S.from_units(F.col(c), scale))
    per_sheet = values.groupBy("doc_id", "column", "sheet").agg(
        number.alias("__sum"),
        F.max("value").alias("__max"),
        F.min("value").alias("__min"),
        F.count("value").alias("__count"),
    )
    per_column = per_sheet.groupBy("doc_id", "column").agg(
        F.sum("__sum").alias("__exact"),
        F.max("__max").alias("max"),
        F.min("__min").alias("min"),
        F.sum("__count").alias("count"),
        F.array_join(F.sort_array(F.collect_list("sheet")), ", ").alias("source_sheets"),
    )
    # One row per column by now, so the window of a document is small.
    totals = per_column.withColumn("__total", F.sum("__exact").over(Window.partitionBy("doc_id")))
    return (
        totals.where("count > 0")
        .withColumn("sum", as_double("__exact"))
        .withColumn("avg", F.col("sum") / F.col("count"))
        .withColumn("ratio", F.when(as_double("__total") != 0, F.col("sum") / as_double("__total")))
        .drop("__exact", "__total")
    )


def plan_calculations(sheet_columns: DataFrame, requests: DataFrame) -> DataFrame:
    """Calculation specs from requests: selected columns x requested operations, numbered per request."""
    chosen = select_columns(sheet_columns, requests)
    grouped = chosen.join(group_column(sheet_columns, requests), ["request_id", "doc_id", "sheet"], "left")
    operations = S.operations_requested("request")
    specs = grouped.select(
        "request_id", "doc_id", "sheet", "col_idx", F.col("header").alias("column"), "group_col",
        S.time_tokens("request").alias("time_tokens"), F.posexplode_outer(operations).alias("op_idx", "operation"),
    )
    label = F.concat(F.col("column"), F.coalesce(S.lookup(fixed.OPERATION_LABELS, F.col("operation")), F.col("operation")))
    # Numbered per document and sheet first, then along them: a request with many sheets is no one task's.
    place = [F.col(c) for c in ("doc_id", "sheet", "col_idx", "op_idx")]
    sheets = specs.groupBy("request_id", "doc_id", "sheet").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("request_id").orderBy("doc_id", "sheet").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sheets.select("request_id", "doc_id", "sheet", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("request_id", "doc_id", "sheet").orderBy(*place)
    numbered = specs.withColumn("__inside", F.row_number().over(inside)).join(offsets, ["request_id", "doc_id", "sheet"])
    return numbered.select(
        "request_id",
        F.concat(F.lit("calc_"), (F.col("__before") + F.col("__inside")).cast("string")).alias("calculation_id"),
        "doc_id", "sheet", "column", "operation", "group_col", "time_tokens",
        F.when(F.col("group_col").isNotNull(), F.concat(F.lit("按"), "group_col", label)).otherwise(label).alias("label"),
    )


def spec_metrics(values: DataFrame, specs: DataFrame, scale: int | None = None) -> DataFrame:
    """Results of many specs (spec_id, doc_id, sheet, column, operation): values are aggregated once, then looked up.

    Specs never multiply the values: the join is between specs and one row per sheet and column. A spec
    whose sheet or column has no values gives no row.
    """
    table = value_metrics(values, ["doc_id", "sheet", "column"], scale)
    total = F.sum("sum").over(Window.partitionBy("doc_id", "sheet"))
    columns = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "sheet"))
    table = table.withColumn("ratio", F.when((columns > 1) & (total != 0), F.col("sum") / total))
    by_name = F.create_map(
        *[part for op in [*BASIC, "ratio"] for part in (F.lit(op), F.col(op).cast("double"))]
    )
    return (
        specs.join(table, ["doc_id", "sheet", "column"])
        .select(*specs.columns, F.try_element_at(by_name, F.col("operation")).alias("value"), "row_start", "row_end")
        .where("value IS NOT NULL")
    )


# --- result rows and evidence -----------------------------------------------------------------


def result_rows(overall: DataFrame, grouped: DataFrame | None, keys: Sequence[str] = ("doc_name", "sheet", "column")) -> DataFrame:
    """Result rows: grouped metrics where there are any for a column, else the overall metrics."""
    plain = overall.select(
        *keys, F.lit(None).cast("string").alias("group_col"), F.lit(None).cast("string").alias("group_value"), "metric", "value"
    )
    if grouped is None:
        return plain
    covered = grouped.select(*keys).distinct()
    return grouped.select(*keys, "group_col", "group_value", "metric", "value").unionByName(
        plain.join(covered, list(keys), "left_anti")
    )


def metric_evidence(metrics: DataFrame, keys: Sequence[str] = ("doc_name", "sheet", "column")) -> DataFrame:
    """One evidence row per column: rows used, sorted operations, place and row range.

    `metrics`: one row per key and metric, with columns metric, count, row_start, row_end. The list of
    operations is bounded by the number of metrics there are.
    """
    grouped = metrics.groupBy(*keys).agg(
        F.max("count").alias("rows_used"),
        F.array_join(F.sort_array(F.collect_set("metric")), ", ").alias("operations"),
        F.min("row_start").alias("row_start"),
        F.max("row_end").alias("row_end"),
    )
    return grouped.select(
        *keys,
        F.concat(F.col("column"), F.lit(" 计算结果")).alias("title"),
        F.concat(F.lit("工作表 "), F.col("sheet"), F.lit(" / 数值列 "), F.col("column")).alias("location"),
        F.concat(
            F.lit("基于 "), F.col("rows_used").cast("string"), F.lit(" 行可计算数据，执行 "), F.col("operations"), F.lit("。")
        ).alias("excerpt"),
        "rows_used", "row_start", "row_end",
    )
