"""Label queries. Jobs are part types: labels are made from parts, result rows from metrics per brand and column.

A label names a brand, a column and a metric in six styles; some name only a part of that, so that
ties and misses occur.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators import labels as L
from gridweave.operators import roles as R
from gridweave.plans import sql as Q
from gridweave.plans.catalog import Catalog, table
from gridweave.plans.grids import CELLS, ROLE_REQUESTS, customer_cells, role_requests
from gridweave.rules import fixed

METRICS = ["sum", "avg", "max"]


def part_cells(spark, folder):
    """Cells of the templates: a label per part in column 1, values beside some of them, a title on top."""
    part = table(spark, folder, "part", "p_partkey")
    key, brand = F.col("p_partkey"), F.col("p_brand")
    text = (
        F.when(key % 6 == 0, F.concat(brand, F.lit("价格合计"))).when(key % 6 == 1, F.concat(brand, F.lit(" 尺寸 平均值"))).when(key % 6 == 2, "合计")
        .when(key % 6 == 3, F.concat(brand, F.lit("价格"))).when(key % 6 == 4, "价格合计").otherwise(F.concat(brand, F.lit("成本最大")))
    )
    row = part.select(F.col("p_type").alias("job_id"), F.lit("模板").alias("sheet"), (key + 3).alias("row_idx"), F.array(
        text, F.when(key % 7 == 0, "600").when(key % 11 == 0, "平均"), F.when(key % 5 == 0, "x")
    ).alias("v"))
    titles = part.select(F.col("p_type").alias("job_id")).distinct().select(
        "job_id", F.lit("模板").alias("sheet"), F.lit(1).cast("bigint").alias("row_idx"), F.array(F.lit("费用汇总")).alias("v")
    )
    cells = row.unionByName(titles).select("job_id", "sheet", "row_idx", F.posexplode_outer("v").alias("p", "value_str"))
    return cells.where("value_str IS NOT NULL").select("job_id", "sheet", "row_idx", (F.col("p") + 1).alias("col_idx"), "value_str")


def part_rows(spark, folder):
    """Result rows: sum, avg and max of price (named 价格 and 费用) and size per type and brand."""
    base = table(spark, folder, "part").select(F.col("p_type").alias("job_id"), F.col("p_brand").alias("group_value")).distinct()
    columns = F.explode(S.string_array(["价格", "尺寸", "费用"])).alias("column")
    rows = base.select("job_id", "group_value", columns).withColumn("metric", F.explode(S.string_array(METRICS)))
    mapping = F.concat_ws("/", "group_value", "column", "metric")
    # A job has as many result rows as brands, columns and metrics: a few hundred.
    order = Window.partitionBy("job_id").orderBy("group_value", "column", "metric")
    return rows.select(
        "job_id", mapping.alias("mapping_id"), F.row_number().over(order).alias("map_idx"), "metric", "group_value", "column",
        F.lit("品牌").alias("group_col"), F.lit("明细").alias("source_sheet"),
    )


PART_CELLS = """
  pv AS (SELECT p_type AS job_id, '模板' AS sheet, p_partkey + 3 AS row_idx, [CASE p_partkey % 6 WHEN 0 THEN p_brand || '价格合计' WHEN 1 THEN p_brand || ' 尺寸 平均值' WHEN 2 THEN '合计'
       WHEN 3 THEN p_brand || '价格' WHEN 4 THEN '价格合计' ELSE p_brand || '成本最大' END, CASE WHEN p_partkey % 7 = 0 THEN '600' WHEN p_partkey % 11 = 0 THEN '平均' END, CASE WHEN p_partkey % 5 = 0 THEN 'x' END] AS v FROM part
     UNION ALL SELECT DISTINCT p_type, '模板', 1, ['费用汇总'] FROM part),
  pr AS (SELECT job_id, sheet, row_idx, unnest(v) AS value_str, generate_subscripts(v, 1) AS col_idx FROM pv),
  cells AS (SELECT job_id, sheet, row_idx, CAST(col_idx AS INTEGER) AS col_idx, value_str FROM pr WHERE value_str IS NOT NULL),
  rws AS (SELECT job_id, group_value || '/' || c || '/' || m AS mapping_id, m AS metric, group_value, c AS col, row_number() OVER (PARTITION BY job_id ORDER BY group_value, c, m) AS map_idx
     FROM (SELECT DISTINCT p_type AS job_id, p_brand AS group_value FROM part), (VALUES ('价格'), ('尺寸'), ('费用')) AS c(c), (VALUES ('sum'), ('avg'), ('max')) AS m(m))"""


def _metric_points(token: str, metric: str) -> str:
    aliases = sorted({S.py_token(w) for w in [metric, *fixed.LABEL_METRIC_ALIASES[metric]]})
    held = "greatest(" + ", ".join(f"CASE WHEN contains({token}, {Q.quote(a)}) THEN {len(a)} ELSE 0 END" for a in aliases if len(a) > 1) + ")"
    return f"CASE WHEN {token} IN ({', '.join(Q.quote(a) for a in aliases)}) THEN 70 WHEN {held} > 0 THEN 46 + {held} ELSE 0 END"


amount = sorted({S.py_token(w) for w in fixed.LABEL_CONTEXT_ALIASES["amount"]})
# Brute force: every label with every result row of its job.
MATCHES = f"""
  lab AS (SELECT job_id, sheet, row_idx, col_idx, value_str AS label, {Q.norm('value_str')} AS tok FROM cells),
  scored AS (SELECT l.job_id, l.sheet, l.row_idx, l.col_idx, label, mapping_id, CASE metric {' '.join(f"WHEN '{m}' THEN {_metric_points('tok', m)}" for m in METRICS)} END AS mp,
     CASE WHEN contains(tok, {Q.norm('group_value')}) THEN 18 ELSE 0 END
     + CASE WHEN contains(tok, col) OR (col = '费用' AND {Q.contains_any('tok', amount)}) THEN 16 ELSE 0 END + CASE WHEN contains(tok, '品牌') THEN 8 ELSE 0 END AS ctx
     FROM lab l JOIN rws USING (job_id) WHERE NOT (row_idx <= 2 AND label = '费用汇总')),
  tot AS (SELECT *, mp + ctx AS score FROM scored WHERE mp = 70 OR (mp > 0 AND ctx > 0)),
  rk AS (SELECT *, rank() OVER w AS r, count(*) OVER (PARTITION BY job_id, sheet, row_idx, col_idx, score) AS same FROM tot WINDOW w AS (PARTITION BY job_id, sheet, row_idx, col_idx ORDER BY score DESC)),
  matches AS (SELECT job_id, sheet, row_idx, col_idx, label, mapping_id, score FROM rk WHERE r = 1 AND same = 1)"""
all_aliases = sorted({S.py_token(w) for ws in fixed.LABEL_METRIC_ALIASES.values() for w in ws})
label_like = f"({Q.norm('value_str')} IN ({', '.join(Q.quote(a) for a in [*fixed.FILL_HEADER_ALIASES, *all_aliases])}) OR {Q.contains_any(Q.norm('value_str'), [a for a in all_aliases if len(a) > 1])})"
POSITIONS = f"""
  sz AS (SELECT job_id, sheet, max(row_idx) AS mr, max(col_idx) AS mc FROM cells GROUP BY ALL),
  off AS (SELECT * FROM (VALUES {', '.join(f"('{d}', {r}, {c}, {n}, {b}, {u}, '{k}')" for d, r, c, n, b, u, k in fixed.VALUE_POSITIONS)}) AS o(direction, dr, dc, distance, blank, used, confidence)),
  spots AS (SELECT m.job_id, m.sheet, m.label, mapping_id, score AS match_score, direction, distance, confidence, m.row_idx + dr AS row_idx, m.col_idx + dc AS col_idx, m.row_idx AS label_row, m.col_idx AS label_col, blank, used
     FROM matches m JOIN sz USING (job_id, sheet), off WHERE m.row_idx + dr <= mr + 2 AND m.col_idx + dc <= mc + 3),
  positions AS (SELECT s.*, value_str AS existing_value, CAST(CASE WHEN value_str IS NULL THEN blank ELSE used END AS DOUBLE) AS position_score FROM spots s LEFT JOIN cells c USING (job_id, sheet, row_idx, col_idx)
     WHERE value_str IS NULL OR NOT {label_like})"""
CANDIDATES = f"""
  offers AS (SELECT job_id, mapping_id, sheet, {Q.a1('row_idx', 'col_idx')} AS cell, round(least(position_score + match_score / 1000.0::DOUBLE, 0.99::DOUBLE), 3) AS score,
     CASE WHEN confidence = 'low' THEN 'low' WHEN match_score >= 84 THEN 'high' WHEN match_score >= 60 THEN 'medium' ELSE 'low' END AS confidence FROM positions),
  best AS (SELECT *, row_number() OVER (PARTITION BY job_id, mapping_id, cell ORDER BY score DESC) AS rn FROM offers),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, mapping_id ORDER BY score DESC, cell) AS rank FROM best WHERE rn = 1),
  cands AS (SELECT r.job_id, r.mapping_id, r.metric, coalesce(rank, 1) AS rank, sheet, coalesce(cell, '') AS cell, CASE WHEN rank IS NULL THEN 'manual_review_required' ELSE 'matched_label' END AS status,
     coalesce(confidence, 'low') AS confidence, coalesce(score, 0.21::DOUBLE) AS score, CASE confidence WHEN 'high' THEN 'low' WHEN 'medium' THEN 'medium' ELSE 'high' END AS risk_level,
     confidence IS NULL OR confidence = 'low' AS requires_confirmation FROM rws r LEFT JOIN (SELECT * FROM ranked WHERE rank <= 3) k USING (job_id, mapping_id))"""


def matches(spark, folder):
    cells = part_cells(spark, folder)
    return cells, L.match_labels(L.label_cells(cells), part_rows(spark, folder))


def register(catalog: Catalog) -> None:
    @catalog.add(f"WITH {PART_CELLS}, {MATCHES} SELECT * FROM matches")
    def label_match(spark, folder):
        """The one result row of each label."""
        return matches(spark, folder)[1]

    @catalog.add(f"WITH {PART_CELLS}, {MATCHES}, f AS (SELECT *, row_number() OVER (PARTITION BY job_id, mapping_id ORDER BY row_idx, col_idx) AS n FROM matches) SELECT * EXCLUDE (n) FROM f WHERE n = 1")
    def label_match_once(spark, folder):
        """The first label of each result row."""
        return L.one_label_per_row(matches(spark, folder)[1])

    @catalog.add(
        f"WITH {PART_CELLS}, {MATCHES}, {POSITIONS} SELECT job_id, sheet, label_row, label_col, mapping_id, direction, distance, confidence, {Q.a1('row_idx', 'col_idx')} AS cell, existing_value, position_score FROM positions"
    )
    def value_positions(spark, folder):
        """Places for the value of each matched label."""
        cells, found = matches(spark, folder)
        return L.value_positions(found, cells).select(
            "job_id", "sheet", "label_row", "label_col", "mapping_id", "direction", "distance", "confidence", S.a1_encode("row_idx", "col_idx").alias("cell"), "existing_value", "position_score"
        )

    @catalog.add(f"WITH {PART_CELLS}, {MATCHES}, {POSITIONS}, {CANDIDATES} SELECT * FROM cands")
    def topk_candidates(spark, folder):
        """Best place and two alternatives of each result row."""
        cells, found = matches(spark, folder)
        return L.rank_candidates(L.value_positions(found, cells), part_rows(spark, folder))

    @catalog.add(
        f"""WITH {PART_CELLS}, {MATCHES}, {POSITIONS}, {CANDIDATES}, j AS (SELECT DISTINCT p_type AS job_id FROM part),
        c AS (SELECT job_id, count(*) AS al, count(*) FILTER (cell <> '') AS m, count(*) FILTER (requires_confirmation) AS u FROM cands WHERE rank = 1 GROUP BY job_id)
        SELECT job_id, CASE WHEN job_id < 'F' THEN 'label_value' ELSE 'result_sheet' END AS mode, CASE WHEN job_id < 'F' THEN '模板' ELSE '结果表' END AS target_sheet,
               CASE WHEN job_id < 'F' THEN m ELSE 0 END AS matched, CASE WHEN job_id < 'F' THEN u ELSE al END AS unconfirmed FROM j JOIN c USING (job_id)"""
    )
    def fill_plan_mode(spark, folder):
        """Mode of each job with its matched and unconfirmed candidates; late job names have no target sheet."""
        cells, found = matches(spark, folder)
        rows = part_rows(spark, folder)
        jobs = table(spark, folder, "part").select(F.col("p_type").alias("job_id")).distinct()
        sheets = jobs.where("job_id < 'F'").select("job_id", F.lit("模板").alias("sheet"), F.lit("label_value").alias("mode"))
        return L.fill_plan_mode(jobs, sheets, L.rank_candidates(L.value_positions(found, cells), rows))

    @catalog.add(
        f"""WITH {PART_CELLS}, s AS (SELECT job_id, sheet, max(row_idx) AS r, max(col_idx) AS c FROM cells GROUP BY ALL), n AS (SELECT job_id, count(*) AS n FROM rws GROUP BY job_id)
        SELECT c.* FROM cells c JOIN s USING (job_id, sheet) JOIN n USING (job_id) WHERE row_idx <= least(s.r + 3, greatest(40, n * 2 + 10), 1000) AND col_idx <= least(s.c + 3, greatest(8, least(s.c + 3, 50)), 50)"""
    )
    def scan_bounds(spark, folder):
        """Cells in the area a bounded scan would visit."""
        return L.within_scan_bounds(part_cells(spark, folder), part_rows(spark, folder), fixed.SCAN_ROW_MAX, fixed.SCAN_COLUMN_MAX)

    hint = Q.contains_any("lower(sheet)", fixed.ROLE_TEMPLATE_SHEET_HINTS)

    @catalog.add(
        f"""WITH {CELLS}, {ROLE_REQUESTS},
        f AS (SELECT doc_id, sheet, row_idx, min(CASE WHEN lower(value_str) IN ('指标', 'metric', 'metrics') THEN col_idx END) AS mc, min(CASE WHEN lower(value_str) IN ('结果', 'value', 'result', '数值') THEN col_idx END) AS rc FROM cells WHERE row_idx <= 6 GROUP BY ALL),
        g AS (SELECT *, CASE WHEN mc IS NULL THEN 0 ELSE 4 END + CASE WHEN rc IS NULL THEN 0 ELSE 4 END AS s FROM f),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY s DESC, row_idx) AS rn FROM g WHERE s > 0 OR row_idx = 1),
        lm AS (SELECT doc_id, sheet, count(*) AS labels FROM cells WHERE value_str IN ('合计', '平均值') GROUP BY ALL),
        sc AS (SELECT request_id, h.doc_id, h.sheet, CAST(CASE WHEN mc IS NOT NULL AND rc IS NOT NULL THEN 5 WHEN rc IS NOT NULL THEN 3 WHEN mc IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN {hint.replace('sheet', 'h.sheet')} THEN 2 ELSE 0 END
             + CASE WHEN contains(lower(request), lower(h.sheet)) THEN 2 ELSE 0 END + least(coalesce(labels, 0), 3) * 2 AS INTEGER) AS score, CASE WHEN rc IS NOT NULL THEN 'header_layout' ELSE 'label_value' END AS mode
             FROM h JOIN requests r ON r.doc_id = h.doc_id LEFT JOIN lm ON lm.doc_id = h.doc_id AND lm.sheet = h.sheet WHERE rn = 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY request_id, doc_id ORDER BY score DESC, sheet) AS n FROM sc WHERE score > 0)
        SELECT request_id, doc_id, sheet, score, mode FROM k WHERE n = 1"""
    )
    def target_sheet(spark, folder):
        """The sheet to fill per request and workbook."""
        cells = customer_cells(spark, folder)
        labels = cells.where(F.col("value_str").isin("合计", "平均值")).groupBy("doc_id", "sheet").agg(F.count(F.lit(1)).alias("labels"))
        return R.target_sheet(R.fill_header(cells), labels, role_requests(spark, folder))
