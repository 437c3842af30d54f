"""Metric queries: lineitem and orders as sheets (a flag or a month is the sheet, the doubles are its columns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators import metrics as M
from gridweave.plans.catalog import Catalog, table

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_values(df):
    """The four number columns of lineitem as long values with a document, a sheet and a row number."""
    return df.select(
        F.col("l_linestatus").alias("doc_id"),
        F.col("l_returnflag").alias("sheet"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("row_idx"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in LINE_COLUMNS])
        ).alias("c"),
    ).select("doc_id", "sheet", "row_idx", "c.*")


LINE_LONG = " UNION ALL ".join(
    f"SELECT l_linestatus AS doc_id, l_returnflag AS sheet, l_orderkey*16+l_linenumber AS row_idx, '{c}' AS col, {c} AS v FROM lineitem"
    for c in LINE_COLUMNS
)
# Decimals of the number columns of the test tables.
SCALE = 4
EXACT = "CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE)"
LINE_STATS = f"""
  SELECT doc_id, sheet, col, {EXACT} AS s, max(v) AS mx, min(v) AS mn, count(v) AS n,
         min(row_idx) AS row_start, max(row_idx) AS row_end
  FROM ({LINE_LONG}) GROUP BY doc_id, sheet, col"""


def register(catalog: Catalog) -> None:
    @catalog.add(
        f"""
        WITH t AS ({LINE_STATS})
        SELECT doc_id, sheet, col AS "column", s AS "sum", s / n AS "avg", mx AS "max", mn AS "min", n AS "count",
               row_start, row_end FROM t"""
    )
    def calc_basic(spark, folder):
        """Sum, average, extremes, count and row range of every number column of every sheet."""
        return M.value_metrics(line_values(table(spark, folder, "lineitem")), ["doc_id", "sheet", "column"], scale=SCALE)

    # Thirds of prices use all 53 bits. In units of 2^-44 they are whole numbers, which 64 bits add up exactly.
    @catalog.add(
        """
        WITH t AS (SELECT l_orderkey AS "key", l_linenumber AS row_idx, l_extendedprice / 3 * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS v FROM lineitem),
        a AS (SELECT "key", CAST(CAST(sum(CAST(v * 17592186044416.0 AS BIGINT)) AS BIGINT) AS DOUBLE) / 17592186044416.0 AS s, count(v) AS n, min(v) AS mn, max(v) AS mx,
                     min(row_idx) AS row_start, max(row_idx) AS row_end FROM t GROUP BY "key")
        SELECT "key", s AS "sum", n AS "count", mn AS "min", mx AS "max", row_start, row_end, s / n AS "avg" FROM a"""
    )
    def calc_reproducible(spark, folder):
        """Signed thirds of prices per order: sums by exponent bins, equal for any order of rows."""
        sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
        values = table(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("row_idx"), (F.col("l_extendedprice") / 3 * sign).alias("value")
        )
        return M.reproducible_metrics(values, ["key"])

    def grouped(spark, folder):
        df = table(spark, folder, "lineitem")
        keyed = df.select(
            F.col("l_returnflag").alias("sheet"),
            M.group_label(F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))).alias("group_value"),
            *LINE_COLUMNS,
        )
        values = {c: F.col(c) for c in LINE_COLUMNS}
        return M.wide_metrics(keyed, ["sheet", "group_value"], values, ["sum", "avg", "max", "min", "count"], scale=SCALE)

    grouped_sql = f"""
        WITH long AS (
          {' UNION ALL '.join(f"SELECT l_returnflag AS sheet, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS VARCHAR) ELSE '空值' END AS group_value, '{c}' AS col, {c} AS v FROM lineitem" for c in LINE_COLUMNS)}
        ), t AS (SELECT sheet, group_value, col, {EXACT} AS s, max(v) AS mx, min(v) AS mn, count(v) AS n FROM long GROUP BY ALL)
        """
    unpivot = " UNION ALL ".join(
        f"SELECT sheet, group_value, col AS \"column\", '{m}' AS metric, {e} AS value FROM t"
        for m, e in [("sum", "s"), ("avg", "s / n"), ("max", "mx"), ("min", "mn"), ("count", "CAST(n AS DOUBLE)")]
    )

    @catalog.add(grouped_sql + unpivot)
    def calc_grouped(spark, folder):
        """The five basic metrics of every number column per sheet and group value."""
        return grouped(spark, folder)

    @catalog.add(
        f"""
        WITH t AS (SELECT l_returnflag AS sheet, {', '.join(f"CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) AS s{i}" for i, c in enumerate(LINE_COLUMNS))}
                   FROM lineitem GROUP BY l_returnflag)
        {' UNION ALL '.join(f"SELECT sheet, '{c}' AS column, 'ratio' AS metric, s{i} / (s0 + s1 + s2 + s3) AS value FROM t" for i, c in enumerate(LINE_COLUMNS))}"""
        .replace(" AS column,", ' AS "column",')
    )
    def calc_ratio(spark, folder):
        """Share of every number column in the total of its sheet."""
        df = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("sheet"), *LINE_COLUMNS)
        return M.wide_metrics(df, ["sheet"], {c: F.col(c) for c in LINE_COLUMNS}, ["ratio"], scale=SCALE)

    @catalog.add(
        """
        WITH t AS (SELECT l_returnflag AS sheet,
            CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS prod,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS amount,
            CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) AS tax FROM lineitem GROUP BY l_returnflag)
        SELECT sheet, '金额' AS "column", 'intensity' AS metric, amount / prod AS value FROM t WHERE prod <> 0
        UNION ALL SELECT sheet, 'tax', 'intensity', tax / prod FROM t WHERE prod <> 0"""
    )
    def calc_intensity(spark, folder):
        """Column sums divided by the sum of the production column (found by its header alias)."""
        df = table(spark, folder, "lineitem").select(
            F.col("l_returnflag").alias("sheet"), "l_quantity", "l_extendedprice", "l_tax"
        )
        values = {"产量": F.col("l_quantity"), "金额": F.col("l_extendedprice"), "tax": F.col("l_tax")}
        return M.wide_metrics(df, ["sheet"], values, ["intensity"], scale=SCALE)

    @catalog.add(
        """
        WITH m AS (
          SELECT o_orderpriority AS sheet, strftime(o_orderdate, '%Y-%m') AS month,
                 CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS orders
          FROM orders GROUP BY 1, 2),
        l AS (SELECT sheet, month, 'total' AS col, total AS v FROM m UNION ALL SELECT sheet, month, 'orders', orders FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY sheet, col ORDER BY month DESC) AS n FROM l),
        p AS (SELECT sheet, col, max(CASE WHEN n = 1 THEN v END) AS last, max(CASE WHEN n = 2 THEN v END) AS prev
              FROM r WHERE n <= 2 GROUP BY sheet, col)
        SELECT sheet, col AS "column", metric, (last - prev) / abs(prev) AS value
        FROM p, (VALUES ('yoy'), ('mom')) AS x(metric) WHERE prev IS NOT NULL AND prev <> 0"""
    )
    def calc_trend(spark, folder):
        """Change of the last month against the month before, per sheet and column; the month is found by its header."""
        months = (
            table(spark, folder, "orders")
            .groupBy(F.col("o_orderpriority").alias("sheet"), F.date_format("o_orderdate", "yyyy-MM").alias("月份"))
            .agg(S.exact_sum("o_totalprice", SCALE).alias("total"), F.count(F.lit(1)).cast("double").alias("orders"))
        )
        values = {"total": F.col("total"), "orders": F.col("orders")}
        return M.trend(months, ["sheet"], values, "月份", None, ["yoy", "mom"])

    @catalog.add(
        f"""
        WITH t AS (SELECT doc_id, col, {EXACT} AS s, max(v) AS mx, min(v) AS mn, count(v) AS n,
                   array_to_string(list_sort(list(DISTINCT sheet)), ', ') AS source_sheets
                   FROM ({LINE_LONG}) GROUP BY doc_id, col)
        SELECT doc_id, col AS "column", s AS "sum", mx AS "max", mn AS "min", n AS "count", source_sheets,
               s / n AS "avg", s / CAST(sum(CAST(s AS DECIMAL(18,4))) OVER (PARTITION BY doc_id) AS DOUBLE) AS ratio FROM t"""
    )
    def calc_cross_sheet(spark, folder):
        """Metrics per document and column over all sheets, with the share of the document total."""
        return M.cross_sheet(line_values(table(spark, folder, "lineitem")), scale=SCALE)

    ops = ["sum", "avg", "max", "min", "count"]

    @catalog.add(
        f"""
        WITH t AS ({LINE_STATS}),
        spec AS (
          SELECT l_linestatus || '/' || l_returnflag || '/' || column_name || '/' || op AS spec_id,
                 l_linestatus AS doc_id, l_returnflag AS sheet, column_name AS col, op
          FROM (SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem),
               (VALUES ('l_quantity'), ('l_tax'), ('no_such_column')) AS c(column_name),
               (VALUES {', '.join(f"('{o}')" for o in ops)}) AS o(op))
        SELECT spec_id, doc_id, sheet, col AS "column", op AS operation,
               CASE op WHEN 'sum' THEN s WHEN 'avg' THEN s / n WHEN 'max' THEN mx WHEN 'min' THEN mn ELSE n END AS value,
               row_start, row_end
        FROM spec JOIN t USING (doc_id, sheet, col)"""
    )
    def calc_spec(spark, folder):
        """Planned calculations (sheet, column, operation) answered from one aggregation of the values."""
        df = table(spark, folder, "lineitem")
        sheets = df.select(F.col("l_linestatus").alias("doc_id"), F.col("l_returnflag").alias("sheet")).distinct()
        specs = (
            sheets.withColumn("column", F.explode(S.string_array(["l_quantity", "l_tax", "no_such_column"])))
            .withColumn("operation", F.explode(S.string_array(ops)))
            .withColumn("spec_id", F.concat_ws("/", "doc_id", "sheet", "column", "operation"))
        )
        return M.spec_metrics(line_values(df), specs, SCALE).select(
            "spec_id", "doc_id", "sheet", "column", "operation", "value", "row_start", "row_end"
        )

    @catalog.add(
        f"""
        {grouped_sql}, g AS (SELECT sheet, col AS "column", 'l_linenumber' AS group_col, group_value, 'sum' AS metric, s AS value FROM t
                             WHERE col IN ('l_quantity', 'l_discount')),
        o AS (SELECT sheet, col AS "column", {EXACT} AS value FROM long GROUP BY sheet, col)
        SELECT sheet, "column", group_col, group_value, metric, value FROM g
        UNION ALL
        SELECT sheet, "column", NULL, NULL, 'sum', value FROM o WHERE "column" NOT IN ('l_quantity', 'l_discount')"""
    )
    def result_rows(spark, folder):
        """Result rows: grouped metrics for two columns, overall metrics for the columns without groups."""
        rows = grouped(spark, folder).where("column IN ('l_quantity', 'l_discount') AND metric = 'sum'")
        df = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("sheet"), *LINE_COLUMNS)
        overall = M.wide_metrics(df, ["sheet"], {c: F.col(c) for c in LINE_COLUMNS}, ["sum"], scale=SCALE)
        return M.result_rows(overall, rows.withColumn("group_col", F.lit("l_linenumber")), ["sheet", "column"])

    @catalog.add(
        f"""
        WITH t AS ({LINE_STATS})
        SELECT doc_id, sheet, col AS "column", col || ' 计算结果' AS title,
               '工作表 ' || sheet || ' / 数值列 ' || col AS location,
               '基于 ' || n || ' 行可计算数据，执行 max, sum。' AS excerpt, n AS rows_used, row_start, row_end
        FROM t"""
    )
    def metric_evidence(spark, folder):
        """One evidence row per calculated column: rows used, operations, place, row range."""
        metrics = M.value_metrics(line_values(table(spark, folder, "lineitem")), ["doc_id", "sheet", "column"], scale=SCALE)
        done = metrics.withColumn("metric", F.explode(S.string_array(["sum", "max"])))
        return M.metric_evidence(done, ["doc_id", "sheet", "column"])

    @catalog.add(
        """
        WITH t AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS sheet, strftime(o_orderdate, '%Y-%m-%d') AS day,
                          o_orderpriority, o_totalprice,
                          contains(strftime(o_orderdate, '%Y-%m-%d'), '1998-12') OR contains(lower(o_orderpriority), '1998-12')
                          OR contains(strftime(o_orderdate, '%Y-%m-%d'), '1996-01') OR contains(lower(o_orderpriority), '1996-01') AS hit
                   FROM orders)
        SELECT o_orderkey, sheet, day, o_orderpriority, o_totalprice FROM t
        WHERE hit OR sheet NOT IN (SELECT sheet FROM t WHERE hit)"""
    )
    def time_filter_fallback(spark, folder):
        """Rows with a time token; years without any such row keep all their rows."""
        df = table(spark, folder, "orders").select(
            "o_orderkey", F.year("o_orderdate").cast("string").alias("sheet"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", "o_totalprice",
        )
        hit = M.row_hit([F.col("day"), F.col("o_orderpriority")], ["1998-12", "1996-01"])
        return M.time_filter(df, ["sheet"], "o_orderkey", hit)

    @catalog.add(
        f"""
        WITH t AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS sheet, o_totalprice AS v,
                          contains(strftime(o_orderdate, '%Y-%m-%d'), '1998-12') AS hit FROM orders),
        a AS (SELECT sheet, bool_or(hit) AS any_hit FROM t GROUP BY sheet),
        s AS (SELECT sheet, {EXACT} AS s, count(v) AS n FROM t JOIN a USING (sheet) WHERE hit OR NOT any_hit GROUP BY sheet)
        SELECT sheet, 'o_totalprice' AS "column", 'sum' AS metric, s AS value FROM s
        UNION ALL SELECT sheet, 'o_totalprice', 'avg', s / n FROM s
        UNION ALL SELECT sheet, 'o_totalprice', 'count', n FROM s"""
    )
    def calc_filtered(spark, folder):
        """Metrics of the rows with a time token, or of all rows where a sheet has none, in one aggregation."""
        df = table(spark, folder, "orders").select(
            F.year("o_orderdate").cast("string").alias("sheet"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice"
        )
        hit = M.row_hit([F.col("day")], ["1998-12"])
        return M.wide_metrics(df, ["sheet"], {"o_totalprice": F.col("o_totalprice")}, ["sum", "avg", "count"], hit=hit, scale=SCALE)
