"""Grid queries. Workbooks are made from `customer`: nation = workbook, market segment = sheet.

Every sheet has a title in row 1 and a header in row 3; each customer is a record at row 4 + c_custkey.
Sheets of the MACHINERY segment are templates with metric labels and partly blank results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators import grid as G
from gridweave.operators import metrics as M
from gridweave.operators import roles as R
from gridweave.plans import sql as Q
from gridweave.plans.catalog import Catalog, table
from gridweave.rules import fixed

LABELS = ["合计", "平均值", "最大", "minimum", "备注"]
BOOK_NAMES = ["detail", "template", "data", "book"]
SOURCE_HEADERS = ["编号", "金额", "编号", "", "单位"]
TEMPLATE_HEADERS = ["指标", "结果"]


def customer_cells(spark, folder):
    """Cells of the workbooks made from customer."""
    df = table(spark, folder, "customer")
    name = F.concat(F.element_at(S.string_array(BOOK_NAMES), F.col("c_nationkey") % 4 + 1), F.lit("_"), F.col("c_nationkey"), F.lit(".xlsx"))
    base = df.select(
        F.concat(F.lit("wb"), F.col("c_nationkey")).alias("doc_id"), name.alias("doc_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "填报").when(F.col("c_mktsegment") == "BUILDING", "明细").otherwise(F.col("c_mktsegment")).alias("sheet"),
        (F.col("c_custkey") + 4).alias("row_idx"), "c_name", "c_acctbal", "c_custkey",
    )
    template = F.col("sheet") == "填报"
    label = F.element_at(S.string_array(LABELS), (F.col("c_custkey") % 5 + 1).cast("int"))
    values = F.when(template, F.array(label, F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal").cast("string")))).otherwise(
        F.array("c_name", F.col("c_acctbal").cast("string"), F.concat(F.lit("¥"), F.col("c_custkey").cast("string")), F.lit(" "), F.lit("元"))
    )
    data = base.select("doc_id", "doc_name", "sheet", "row_idx", F.posexplode_outer(values).alias("p", "raw"))
    heads = base.select("doc_id", "doc_name", "sheet").distinct()
    titles = heads.select(
        "doc_id", "doc_name", "sheet", F.lit(1).cast("bigint").alias("row_idx"), F.lit(0).alias("p"), F.lit("客户数据汇总").alias("raw")
    )
    names = heads.select(
        "doc_id", "doc_name", "sheet", F.lit(3).cast("bigint").alias("row_idx"),
        F.posexplode_outer(F.when(template, S.string_array(TEMPLATE_HEADERS)).otherwise(S.string_array(SOURCE_HEADERS))).alias("p", "raw"),
    )
    value = S.blank_to_null("raw")
    return data.unionByName(titles).unionByName(names).select(
        "doc_id", "doc_name", "sheet", "row_idx", (F.col("p") + 1).alias("col_idx"), value.alias("value_str"), S.parse_numeric("raw").alias("value_num")
    ).where("value_str IS NOT NULL")


def _array(words) -> str:
    return "[" + ", ".join(Q.quote(w) for w in words) + "]"


CELLS = f"""
  base AS (SELECT 'wb' || c_nationkey AS doc_id, {_array(BOOK_NAMES)}[c_nationkey % 4 + 1] || '_' || c_nationkey || '.xlsx' AS doc_name,
     CASE c_mktsegment WHEN 'MACHINERY' THEN '填报' WHEN 'BUILDING' THEN '明细' ELSE c_mktsegment END AS sheet, c_custkey + 4 AS row_idx, * FROM customer),
  vals AS (SELECT doc_id, doc_name, sheet, row_idx, CASE WHEN sheet = '填报'
       THEN [{_array(LABELS)}[c_custkey % 5 + 1], CASE WHEN c_custkey % 7 = 0 THEN CAST(c_acctbal AS VARCHAR) END]
       ELSE [c_name, CAST(c_acctbal AS VARCHAR), '¥' || c_custkey, ' ', '元'] END AS v FROM base
     UNION ALL SELECT DISTINCT doc_id, doc_name, sheet, 1, ['客户数据汇总'] FROM base
     UNION ALL SELECT DISTINCT doc_id, doc_name, sheet, 3, CASE WHEN sheet = '填报' THEN {_array(TEMPLATE_HEADERS)} ELSE {_array(SOURCE_HEADERS)} END FROM base),
  raw AS (SELECT doc_id, doc_name, sheet, row_idx, unnest(v) AS raw, generate_subscripts(v, 1) AS col_idx FROM vals),
  cells AS (SELECT doc_id, doc_name, sheet, row_idx, CAST(col_idx AS INTEGER) AS col_idx, {Q.strip('raw')} AS value_str, {Q.parse_numeric('raw')} AS value_num
     FROM raw WHERE raw IS NOT NULL AND {Q.strip('raw')} <> '')"""

signals = f"({Q.norm('value_str')} IN ({', '.join(Q.quote(w) for w in fixed.HEADER_SIGNALS)}) OR {Q.norm('value_str')} LIKE 'scope%')"
titles = f"({Q.norm('value_str')} IN ({', '.join(Q.quote(w) for w in fixed.SHEET_TEMPLATE_HINTS)}) OR {Q.contains_any('value_str', fixed.TITLE_ROW_HINTS)})"
metric_label = "CASE " + " ".join(
    f"WHEN {Q.norm('value_str')} IN ({', '.join(Q.quote(S.py_token(w)) for w in [m, *ws])}) THEN '{m}'" for m, ws in fixed.PROFILE_METRIC_ALIASES.items()
) + " END"
HEADER = f"""
  grid_rows AS (SELECT doc_id, sheet, row_idx, any_value(doc_name) AS doc_name, count(*) AS n, count(value_num) AS nums, sum(CASE WHEN {signals} THEN 1 ELSE 0 END) AS hits,
      bool_or({titles}) AS title FROM cells GROUP BY doc_id, sheet, row_idx),
  nexts AS (SELECT *, lead(nums) OVER (PARTITION BY doc_id, sheet ORDER BY row_idx) AS next_nums FROM grid_rows),
  scores AS (SELECT *, least(n, 4) + 3 * least(hits, 3) + CASE WHEN n = 1 THEN -4 ELSE 0 END
      + CASE WHEN nums = 0 THEN 1 WHEN nums >= greatest(1, n - 1) THEN -3 ELSE 0 END + CASE WHEN title AND n <= 2 THEN -3 ELSE 0 END
      + CASE WHEN next_nums >= 1 THEN 2 ELSE 0 END AS score FROM nexts WHERE row_idx <= 8),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY score DESC, hits DESC, n DESC, row_idx) AS rn FROM scores),
  headers AS (SELECT doc_id, sheet, doc_name, row_idx AS header_row, CAST(score AS INTEGER) AS score,
      CASE WHEN score >= 9 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS header_confidence, n AS header_cells FROM ranked WHERE rn = 1)"""
# The two header rows of the made workbooks, repaired by hand.
NAMES = """
  names AS (SELECT doc_id, sheet, unnest(CASE WHEN sheet = '填报' THEN ['指标', '结果'] ELSE ['编号', '金额', '编号_2', 'column_4', '单位'] END) AS header,
      unnest(CASE WHEN sheet = '填报' THEN [1, 2] ELSE [1, 2, 3, 4, 5] END) AS col_idx FROM headers),
  data AS (SELECT c.*, n.header, h.header_row FROM cells c JOIN headers h USING (doc_id, sheet) JOIN names n USING (doc_id, sheet, col_idx) WHERE row_idx > header_row)"""
ANCHORS = f"""
  anchors AS (SELECT * FROM (SELECT c.doc_id, c.sheet, c.row_idx, c.col_idx, {Q.a1('c.row_idx', 'c.col_idx')} AS cell, value_str AS label, {metric_label} AS metric,
        c.row_idx = header_row AND header_confidence <> 'low' AND header_cells >= 2 AS in_header
     FROM cells c JOIN headers h USING (doc_id, sheet)) WHERE metric IS NOT NULL AND NOT in_header)"""
ZONES = f"""
  offs AS (SELECT * FROM (VALUES (0, 'right', 0, 1, 1), (1, 'right', 0, 2, 2), (2, 'right', 0, 3, 3), (3, 'down', 1, 0, 1), (4, 'down', 2, 0, 2)) AS o(o, direction, dr, dc, distance)),
  spots AS (SELECT doc_id, sheet, cell AS anchor_cell, metric, o, direction, distance, row_idx + dr AS row_idx, col_idx + dc AS col_idx FROM anchors, offs),
  taken AS (SELECT doc_id, sheet, row_idx, col_idx FROM cells WHERE {signals} OR {titles} OR ({metric_label}) IS NOT NULL),
  free AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet, anchor_cell ORDER BY o) AS rn FROM spots s
     WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = s.doc_id AND t.sheet = s.sheet AND t.row_idx = s.row_idx AND t.col_idx = s.col_idx)),
  zones AS (SELECT doc_id, sheet, anchor_cell, metric, {Q.a1('row_idx', 'col_idx')} AS cell, row_idx, col_idx, direction, distance FROM free WHERE rn <= 3)"""
PROFILE = f"""
  numeric AS (SELECT doc_id, sheet, col_idx, header, count(*) AS filled, count(value_num) AS numbers FROM data GROUP BY ALL),
  nc AS (SELECT doc_id, sheet, string_agg(header, ',' ORDER BY col_idx) AS numeric_columns, count(*) AS n_numeric FROM numeric WHERE numbers > 0 GROUP BY ALL),
  hc AS (SELECT doc_id, sheet, string_agg(header, ',' ORDER BY col_idx) AS header_list FROM names GROUP BY ALL),
  rc AS (SELECT doc_id, sheet, count(DISTINCT row_idx) AS row_count FROM data GROUP BY ALL),
  ac AS (SELECT doc_id, sheet, count(*) AS anchors FROM anchors GROUP BY ALL), zc AS (SELECT doc_id, sheet, count(*) AS zones FROM zones GROUP BY ALL),
  joined AS (SELECT h.doc_id, h.sheet, doc_name, header_row, header_confidence, coalesce(row_count, 0) AS row_count, coalesce(anchors, 0) AS anchors, coalesce(zones, 0) AS zones,
     header_list, coalesce(numeric_columns, '') AS numeric_columns, coalesce(n_numeric, 0) AS n_numeric,
     CASE WHEN h.sheet = '填报' THEN 5 ELSE 0 END + least(coalesce(anchors, 0), 3) * 2 + CASE WHEN coalesce(row_count, 0) <= 3 THEN 1 ELSE 0 END
       + CASE WHEN {Q.contains_any('lower(h.sheet)', fixed.SHEET_TEMPLATE_HINTS)} THEN 2 ELSE 0 END AS tscore,
     CASE WHEN coalesce(n_numeric, 0) > 0 THEN 4 + least(n_numeric, 2) ELSE 0 END + CASE WHEN coalesce(row_count, 0) >= 5 THEN 2 ELSE 0 END
       + CASE WHEN contains(header_list, '金额') THEN 1 ELSE 0 END AS sscore
     FROM headers h LEFT JOIN hc USING (doc_id, sheet) LEFT JOIN nc USING (doc_id, sheet) LEFT JOIN rc USING (doc_id, sheet) LEFT JOIN ac USING (doc_id, sheet) LEFT JOIN zc USING (doc_id, sheet)),
  profile AS (SELECT *, CASE WHEN tscore >= sscore + 2 THEN 'template_like' WHEN sscore >= tscore + 1 THEN 'source_like' ELSE 'unknown' END AS sheet_role FROM joined)"""
ALL = f"{CELLS}, {HEADER}, {NAMES}, {ANCHORS}, {ZONES}, {PROFILE}"

# One request per region, over the workbooks of its nations.
REQUEST_TEXT = ["汇总 detail_{n} 到 template_1", "fill template_9.xlsx", "请计算金额合计", "use data_2.xlsx and book_3", "data"]


def role_requests(spark, folder):
    text = F.element_at(S.string_array([t.replace("{n}", "4") for t in REQUEST_TEXT]), F.col("n_regionkey") + 1)
    nation = table(spark, folder, "nation")
    name = F.concat(F.element_at(S.string_array(BOOK_NAMES), F.col("n_nationkey") % 4 + 1), F.lit("_"), F.col("n_nationkey"), F.lit(".xlsx"))
    return nation.select(
        F.col("n_regionkey").alias("request_id"), text.alias("request"), F.concat(F.lit("wb"), F.col("n_nationkey")).alias("doc_id"),
        name.alias("doc_name"), F.col("n_nationkey").alias("doc_idx"),
    )


ROLE_REQUESTS = (
    f"requests AS (SELECT n_regionkey AS request_id, {_array([t.replace('{n}', '4') for t in REQUEST_TEXT])}[n_regionkey + 1] AS request, 'wb' || n_nationkey AS doc_id, "
    f"{_array(BOOK_NAMES)}[n_nationkey % 4 + 1] || '_' || n_nationkey || '.xlsx' AS doc_name, n_nationkey AS doc_idx FROM nation)"
)


def _hints(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {Q.quote(w)}) AS INTEGER)" for w in words) + ")"


MENTIONED = "(contains(lower(request), lower(doc_name)) OR contains(lower(request), regexp_replace(lower(doc_name), '\\.[^.]*$', '')))"
ROLE_SCORES = f"""
  points AS (SELECT doc_id, sum(CASE WHEN sheet_role = 'source_like' THEN 4 ELSE 0 END + CASE WHEN row_count > 0 AND n_numeric > 0 THEN CASE WHEN row_count >= 5 THEN 5 ELSE 3 END ELSE 0 END
       + CASE WHEN {Q.contains_any('lower(sheet)', fixed.ROLE_SOURCE_SHEET_HINTS)} THEN 2 ELSE 0 END) AS sp,
     sum(CASE WHEN sheet_role = 'template_like' THEN 4 ELSE 0 END + CASE WHEN {Q.contains_any('lower(sheet)', fixed.ROLE_TEMPLATE_SHEET_HINTS)} THEN 2 ELSE 0 END
       + CASE WHEN sheet = '填报' THEN 5 ELSE 0 END + least(anchors, 3) * 2 + least(zones, 3) + CASE WHEN row_count <= 3 AND n_numeric = 0 THEN 1 ELSE 0 END) AS tp
     FROM profile GROUP BY doc_id),
  scored AS (SELECT r.*, {MENTIONED} AS mentioned,
     CAST(coalesce(sp, 0) + CASE WHEN {MENTIONED} THEN 2 ELSE 0 END + 3 * {_hints('lower(doc_name)', fixed.ROLE_SOURCE_HINTS)} AS INTEGER) AS source_score,
     CAST(coalesce(tp, 0) + CASE WHEN {MENTIONED} THEN 2 ELSE 0 END + 3 * {_hints('lower(doc_name)', fixed.ROLE_TEMPLATE_HINTS)} AS INTEGER) AS template_score
     FROM requests r LEFT JOIN points USING (doc_id)),
  facts AS (SELECT *, count(*) OVER w AS docs, max(source_score) OVER w AS top,
     bool_or(mentioned AND source_score >= 5) OVER w AS ns, bool_or(mentioned AND template_score >= 5) OVER w AS nt,
     bool_or(source_score > 0 AND source_score >= template_score) OVER w AS fs, bool_or(template_score > 0 AND template_score >= source_score) OVER w AS ft,
     row_number() OVER (PARTITION BY request_id ORDER BY source_score DESC, doc_idx) AS sr FROM scored WINDOW w AS (PARTITION BY request_id)),
  ranks AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY source_score < top DESC, template_score DESC, doc_idx) AS tr FROM facts),
  roles AS (SELECT *, docs = 1 OR CASE WHEN ns THEN mentioned AND source_score >= 5 WHEN fs THEN source_score > 0 AND source_score >= template_score ELSE sr = 1 END AS is_source,
     docs = 1 OR CASE WHEN nt THEN mentioned AND template_score >= 5 WHEN ft THEN template_score > 0 AND template_score >= source_score ELSE tr = 1 END AS is_template FROM ranks)"""


def register(catalog: Catalog) -> None:
    @catalog.add(f"WITH {CELLS}, {HEADER} SELECT * FROM headers")
    def detect_header(spark, folder):
        """Header row, score and confidence of every sheet."""
        return G.detect_header(customer_cells(spark, folder))

    def parts(spark, folder):
        cells = customer_cells(spark, folder)
        return cells, G.sheet_heads(cells)

    @catalog.add(f"WITH {CELLS}, {HEADER}, {NAMES} SELECT doc_id, sheet, col_idx, header FROM names")
    def unique_headers(spark, folder):
        """Repaired header names of every sheet."""
        return G.unique_headers(parts(spark, folder)[1])

    @catalog.add(f"WITH {CELLS}, {HEADER}, {NAMES} SELECT doc_id, sheet, row_idx, col_idx, header, value_str, value_num FROM data")
    def grid_records(spark, folder):
        """Records of every sheet in long form."""
        return G.records(*parts(spark, folder)).select("doc_id", "sheet", "row_idx", "col_idx", "header", "value_str", "value_num")

    @catalog.add(
        f"WITH {CELLS}, {HEADER}, {NAMES} SELECT doc_id, sheet, col_idx, header, count(*) AS filled, count(value_num) AS numbers, count(value_num) > 0 AS is_numeric FROM data GROUP BY doc_id, sheet, col_idx, header"
    )
    def numeric_columns(spark, folder):
        """Filled cells and numbers per column; which columns are numeric."""
        return G.numeric_columns(G.records(*parts(spark, folder)))

    low_header = f"lower({Q.strip('header')})"
    alias = "coalesce(CASE " + " ".join(f"WHEN {low_header} IN ({', '.join(Q.quote(w.lower()) for w in [name, *words])}) THEN {Q.quote(name)}" for name, words in fixed.CALC_HEADER_ALIASES.items()) + f" END, {low_header})"
    by_alias = " OR ".join(f"({alias} = {Q.quote(name)} AND {Q.contains_any('lower(request)', words)})" for name, words in fixed.CALC_HEADER_ALIASES.items())
    named_columns = f"""cols AS (SELECT doc_id, sheet, col_idx, header, count(value_num) > 0 AS is_numeric FROM data GROUP BY doc_id, sheet, col_idx, header),
        asked AS (SELECT request_id, c.*, ({low_header} <> '' AND contains(lower(request), {low_header})) OR {by_alias} AS named FROM cols c JOIN requests USING (doc_id))"""

    def sheet_columns(spark, folder):
        return G.numeric_columns(G.records(*parts(spark, folder))).select("doc_id", "sheet", "col_idx", "header", "is_numeric")

    @catalog.add(f"WITH {CELLS}, {HEADER}, {NAMES} SELECT DISTINCT header, {alias} AS canonical FROM data")
    def header_alias(spark, folder):
        """Canonical name of every header."""
        return sheet_columns(spark, folder).select("header").distinct().select("header", S.header_alias("header").alias("canonical"))

    @catalog.add(
        f"""WITH {CELLS}, {HEADER}, {NAMES}, {ROLE_REQUESTS}, {named_columns},
        n AS (SELECT *, bool_or(named) OVER (PARTITION BY request_id, doc_id, sheet) AS one_named FROM asked WHERE is_numeric)
        SELECT request_id, doc_id, sheet, col_idx, header FROM n WHERE named OR NOT one_named"""
    )
    def column_select(spark, folder):
        """Numeric columns that each request names, or all of them."""
        return M.select_columns(sheet_columns(spark, folder), role_requests(spark, folder).select("request_id", "doc_id", "request")).select("request_id", "doc_id", "sheet", "col_idx", "header")

    @catalog.add(
        f"""WITH {CELLS}, {HEADER}, {NAMES}, {ROLE_REQUESTS.replace("requests AS", "plain_requests AS")},
        requests AS (SELECT request_id, doc_id, request || CASE WHEN request_id % 3 = 0 THEN ' 按单位' WHEN request_id % 3 = 1 THEN ' 按编号和单位' ELSE '' END AS request FROM plain_requests), {named_columns}
        SELECT request_id, doc_id, sheet, arg_min(header, col_idx) AS group_col FROM asked WHERE NOT is_numeric AND named GROUP BY request_id, doc_id, sheet"""
    )
    def group_column(spark, folder):
        """The column that each request wants groups of; some name one header, some two, some none."""
        more = F.when(F.col("request_id") % 3 == 0, " 按单位").when(F.col("request_id") % 3 == 1, " 按编号和单位").otherwise("")
        requests = role_requests(spark, folder).select("request_id", "doc_id", F.concat("request", more).alias("request"))
        return M.group_column(sheet_columns(spark, folder), requests)

    @catalog.add(f"WITH {CELLS}, {HEADER}, {ANCHORS} SELECT doc_id, sheet, row_idx, col_idx, cell, label, metric FROM anchors")
    def label_anchors(spark, folder):
        """Metric labels of every sheet."""
        cells = customer_cells(spark, folder)
        return G.label_anchors(cells, G.detect_header(cells))

    @catalog.add(f"WITH {CELLS}, {HEADER}, {ANCHORS}, {ZONES} SELECT * FROM zones")
    def value_zones(spark, folder):
        """Places for the values of the metric labels."""
        cells = customer_cells(spark, folder)
        return G.value_zones(cells, G.label_anchors(cells, G.detect_header(cells)))

    @catalog.add(
        f"""WITH {ALL} SELECT doc_id, sheet, header_row, header_confidence, row_count, anchors, zones, header_list, numeric_columns, sheet_role,
            '识别表头位于第 ' || header_row || ' 行（' || header_confidence || '）。工作表类型推断为 ' || sheet_role || '。检测到 ' || anchors || ' 个标签锚点和 ' || zones || ' 个候选值位。' AS layout_summary FROM profile"""
    )
    def sheet_profile(spark, folder):
        """Whole profile of every sheet with its role."""
        return G.sheet_profile(customer_cells(spark, folder)).select(
            "doc_id", "sheet", "header_row", "header_confidence", "row_count", "anchors", "zones", F.array_join("headers", ",").alias("header_list"),
            F.array_join("numeric_columns", ",").alias("numeric_columns"), "sheet_role", "layout_summary",
        )

    @catalog.add(
        f"""WITH {CELLS}, {HEADER}, {NAMES},
        lines AS (SELECT doc_id, sheet, row_idx, max(header_row) AS hr, string_agg(header || '=' || value_str, '；' ORDER BY col_idx) AS c FROM data GROUP BY doc_id, sheet, row_idx),
        num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY row_idx) AS n FROM lines),
        blk AS (SELECT doc_id, sheet, (n - 1) // 8 AS block, hr + n AS row_no, '第 ' || (hr + n) || ' 行：' || c AS line FROM num)
        SELECT doc_id, sheet, CAST(block + 1 AS BIGINT) AS seg_idx, 'table_row_block' AS kind, sheet || ' 行 ' || min(row_no) || '-' || max(row_no) AS label,
               string_agg(line, chr(10) ORDER BY row_no) AS text, min(row_no) AS row_start, max(row_no) AS row_end FROM blk GROUP BY doc_id, sheet, block"""
    )
    def row_blocks(spark, folder):
        """Data rows as text segments of eight rows."""
        return G.row_blocks(G.records(*parts(spark, folder)))

    @catalog.add(
        f"""WITH {ALL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sheet) AS n, count(*) OVER (PARTITION BY doc_id) AS sheets FROM profile)
        SELECT doc_id, max(sheets) AS sheets, any_value(doc_name) || ' 已包含 ' || max(sheets) || ' 个工作表的结构化数据。' || chr(10) ||
            string_agg('工作表 ' || sheet || '：表头 ' || replace(header_list, ',', '、') || '，共 ' || row_count || ' 行数据。', chr(10) ORDER BY n) AS summary
        FROM o WHERE n <= 3 GROUP BY doc_id"""
    )
    def structured_summary(spark, folder):
        """Summary text of every workbook."""
        return G.structured_summary(G.sheet_profile(customer_cells(spark, folder)))

    @catalog.add(
        f"""WITH {ALL} SELECT doc_id, sheet, 'sheet_summary' AS kind, sheet || ' 概览' AS label,
            '工作表 ' || sheet || '。表头：' || replace(header_list, ',', '、') || '。数据行数：' || row_count || '。识别表头位于第 ' || header_row || ' 行（' || header_confidence || '）。工作表类型推断为 ' || sheet_role
            || '。检测到 ' || anchors || ' 个标签锚点和 ' || zones || ' 个候选值位。' AS text FROM profile"""
    )
    def sheet_summary(spark, folder):
        """Summary segment of every sheet."""
        return G.sheet_summary(G.sheet_profile(customer_cells(spark, folder)))

    @catalog.add(
        f"""WITH {ALL}, {ROLE_REQUESTS}, {ROLE_SCORES}
        SELECT request_id, doc_id, mentioned, source_score, template_score,
          CASE WHEN source_score > 0 AND template_score > 0 AND abs(source_score - template_score) <= 2 THEN 'medium' WHEN abs(source_score - template_score) >= 5 THEN 'high'
               WHEN abs(source_score - template_score) >= 2 THEN 'medium' ELSE 'low' END AS confidence,
          is_source, is_template, CASE WHEN is_source AND is_template THEN 'source_and_template' WHEN is_template THEN 'template' WHEN is_source THEN 'source' ELSE 'unselected' END AS role
        FROM roles"""
    )
    def role_selection(spark, folder):
        """Scores, confidence and role of every workbook in every request."""
        scores = R.role_scores(role_requests(spark, folder), G.sheet_profile(customer_cells(spark, folder)))
        return R.select_roles(scores).select(
            "request_id", "doc_id", "mentioned", "source_score", "template_score", "confidence", "is_source", "is_template", "role"
        )

    @catalog.add(
        f"""WITH {ALL}, {ROLE_REQUESTS}, {ROLE_SCORES}
        SELECT c.doc_id, count(*) AS cells FROM cells c WHERE EXISTS (SELECT 1 FROM roles r WHERE r.doc_id = c.doc_id AND r.is_source) GROUP BY c.doc_id"""
    )
    def role_filter(spark, folder):
        """Cells of the workbooks with the source role."""
        cells = customer_cells(spark, folder)
        roles = R.select_roles(R.role_scores(role_requests(spark, folder), G.sheet_profile(cells)))
        chosen = R.documents_with_role(role_requests(spark, folder), roles, "source").select("doc_id").distinct()
        return cells.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"))

    @catalog.add(
        f"""WITH {ALL}, {ROLE_REQUESTS}, s AS (SELECT request_id, doc_id, sheet, row_count + 2 * n_numeric + CASE WHEN sheet_role = 'source_like' THEN 5 ELSE 0 END AS score, doc_idx
            FROM requests JOIN profile USING (doc_id) WHERE row_count > 0),
        r AS (SELECT request_id, max(score * 1000 - doc_idx) AS top FROM s GROUP BY request_id)
        SELECT s.request_id, s.doc_id, s.score FROM s JOIN r ON s.request_id = r.request_id AND s.score * 1000 - s.doc_idx = r.top GROUP BY ALL"""
    )
    def best_source_table(spark, folder):
        """The workbook to transfer from, per request."""
        return R.best_source_table(role_requests(spark, folder), G.sheet_profile(customer_cells(spark, folder))).select("request_id", "doc_id", "score")

    @catalog.add(
        f"""WITH {CELLS}, r AS (SELECT doc_id, sheet, row_idx, count(*) AS n FROM cells WHERE row_idx <= 8 GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY n DESC, row_idx) AS rn FROM r WHERE n >= 2),
        f AS (SELECT doc_id, sheet, row_idx, min(CASE WHEN lower(value_str) IN ('指标', 'metric', 'metrics') THEN col_idx END) AS mc, min(CASE WHEN lower(value_str) IN ('结果', 'value', 'result', '数值') THEN col_idx END) AS rc
              FROM cells WHERE row_idx <= 6 GROUP BY ALL),
        g AS (SELECT *, CASE WHEN mc IS NULL THEN 0 ELSE 4 END + CASE WHEN rc IS NULL THEN 0 ELSE 4 END AS s FROM f),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY s DESC, row_idx) AS rn FROM g WHERE s > 0 OR row_idx = 1)
        SELECT t.doc_id, t.sheet, t.row_idx AS transfer_header, h.row_idx AS fill_header, h.mc AS metric_col, h.rc AS result_col FROM t JOIN h USING (doc_id, sheet) WHERE t.rn = 1 AND h.rn = 1"""
    )
    def target_headers(spark, folder):
        """Header row of every sheet as a transfer target and as a fill template."""
        cells = customer_cells(spark, folder)
        return R.transfer_header(cells).withColumnRenamed("header_row", "transfer_header").join(
            R.fill_header(cells).withColumnRenamed("header_row", "fill_header"), ["doc_id", "sheet"]
        ).select("doc_id", "sheet", "transfer_header", "fill_header", "metric_col", "result_col")
