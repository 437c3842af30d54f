"""Fill queries: orders as source rows and candidates, customer and supplier as target tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators import fill as L
from gridweave.operators.scaling import store
from gridweave.plans import sql as Q
from gridweave.plans.catalog import Catalog, table

SOURCE_HEADERS = ["项目编号", "项目名称", "金额", "备注金额"]
TARGET_HEADERS = [["编号", "名称", "金额"], ["金额合计", "金额", "项目"], ["项目编号", "", " 金额 ", "x"], ["备注"]]
# The mapping of each list of target headers, derived by hand: list, source, target, column, score.
EXPECTED = [
    (0, "项目编号", "编号", 1, 0.72), (0, "项目名称", "名称", 2, 0.72), (0, "金额", "金额", 3, 1.0),
    (1, "金额", "金额合计", 1, 0.72), (1, "备注金额", "金额", 2, 0.72), (1, "项目名称", "项目", 3, 0.72),
    (2, "项目编号", "项目编号", 1, 1.0), (2, "金额", "金额", 3, 1.0), (3, "备注金额", "备注", 1, 0.72),
]
EXPECTED_KEYS = [(0, "项目编号", "编号", 1, 4), (1, "项目名称", "项目", 3, 8), (2, "项目编号", "项目编号", 1, 8)]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(Q.quote(v) if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows)


def header_pairs(spark, folder):
    """One pair of header lists per customer."""
    lists = F.array(*[S.string_array(h) for h in TARGET_HEADERS])
    return table(spark, folder, "customer", "c_custkey").select(
        F.col("c_custkey").alias("pair_id"), S.string_array(SOURCE_HEADERS).alias("source_headers"),
        F.element_at(lists, (F.col("c_custkey") % 4 + 1).cast("int")).alias("target_headers"),
    )


def order_source(spark, folder):
    """Orders as source rows: an amount that is sometimes missing, a text that is sometimes a placeholder."""
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "-").when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("note"),
    )


def customer_target(spark, folder):
    """Customers as a target table with blanks, placeholders and values that are equal by chance."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(key % 3 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(key % 4 == 0, "待填").when(key % 4 == 1, "3-MEDIUM").when(key % 4 == 2, F.col("c_mktsegment")).alias("note"),
    )


SOURCE = """s AS (SELECT o_orderkey, o_custkey, CAST(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS VARCHAR) AS v0,
   CASE WHEN o_orderpriority = '1-URGENT' THEN '-' WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS v1 FROM orders)"""
TARGET = """t AS (SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS VARCHAR) AS x0,
   CASE c_custkey % 4 WHEN 0 THEN '待填' WHEN 1 THEN '3-MEDIUM' WHEN 2 THEN c_mktsegment END AS x1 FROM customer)"""


def _attempts(i: int) -> str:
    v, x = f"v{i}", f"x{i}"
    return f"""
      SELECT o_orderkey AS source_row, c_custkey AS target_row, {v} AS value, {x} AS before, {Q.is_empty_like(x)} AS open_cell,
             min(CASE WHEN NOT {Q.is_empty_like(v)} THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS first_row,
             first_value({v}) OVER (PARTITION BY o_custkey ORDER BY CASE WHEN {Q.is_empty_like(v)} THEN 1 ELSE 0 END, o_orderkey) AS first_value
      FROM s JOIN t ON o_custkey = c_custkey"""


def _audit(i: int, source: str, target: str, score: float) -> str:
    later = "(open_cell AND first_row IS NOT NULL AND source_row > first_row)"
    return f"""
      SELECT source_row, target_row, '{source}' AS source_col, '{target}' AS target_col,
        CASE WHEN value IS NULL THEN 'source_empty' WHEN open_cell AND NOT {later} THEN 'written'
             WHEN {Q.loose_equal('cell', 'value')} THEN 'kept_existing' ELSE 'preserved_existing' END AS status,
        value, CASE WHEN {later} THEN first_value ELSE before END AS existing_value, {score}::DOUBLE AS score, '{'low' if score >= 1 else 'medium'}' AS risk_level
      FROM (SELECT *, CASE WHEN open_cell THEN first_value ELSE before END AS cell FROM ({_attempts(i)}))"""


KEYED_AUDIT = f"SELECT * FROM ({_audit(0, 'amount', 'balance', 1.0)} UNION ALL {_audit(1, 'note', 'note', 0.72)})"


def keyed(spark, folder) -> L.KeyedFill:
    return L.KeyedFill(
        order_source(spark, folder), customer_target(spark, folder), ("o_custkey", "c_custkey"),
        [("amount", "balance", 1.0), ("note", "note", 0.72)], "o_orderkey", "c_custkey",
    )


# Candidates: one per order, the customer is the job.


def candidates(spark, folder):
    key = F.col("o_orderkey")
    confidence = F.when(F.col("o_orderpriority") == "5-LOW", "low").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "medium").otherwise("high")
    row = (key % 40 + 1).cast("string")

    def option(sheet: str, letter: str, score: float):
        return F.struct(F.lit(sheet).alias("sheet"), F.concat(F.lit(letter), row).alias("cell"), F.lit(score).alias("score"))

    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("job_id"), key.alias("map_idx"), F.concat(F.lit("map_"), key).alias("mapping_id"),
        F.element_at(S.string_array(["sum", "avg", "max"]), (key % 3 + 1).cast("int")).alias("metric"),
        F.col("o_totalprice").cast("string").alias("value"), F.lit("o_totalprice").alias("column"), F.lit("orders").alias("doc_name"),
        F.lit("matched_label").alias("status"), confidence.alias("confidence"), L.risk_of(confidence).alias("risk_level"),
        (confidence == "low").alias("requires_confirmation"), F.array(F.lit("label")).alias("reasons"),
        F.array(option("S1", "B", 0.84), option("S1", "C", 0.66), option("S2", "D", 0.44)).alias("options"),
    )


def overrides(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").where(key % 5 == 0).select(
        F.col("o_custkey").alias("job_id"), F.concat(F.lit("map_"), key).alias("mapping_id"), (key % 10 != 0).alias("enabled"),
        F.when(key % 15 == 0, "nosheet").when(key % 25 == 0, "S2").alias("sheet"), F.when(key % 35 == 0, "e5").alias("cell"),
        F.when(key % 4 == 0, "force_overwrite").when(key % 4 == 1, "odd").alias("write_policy"), (key % 7 - 1).cast("int").alias("candidate_index"),
    )


def job_sheets(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("job_id"), F.explode(S.string_array(["S1", "S2"])).alias("sheet"))


CANDIDATES = """
  cand AS (SELECT o_custkey AS job_id, o_orderkey AS map_idx, 'map_' || o_orderkey AS mapping_id, ['sum', 'avg', 'max'][o_orderkey % 3 + 1] AS metric,
     CAST(o_totalprice AS VARCHAR) AS value, CASE o_orderpriority WHEN '5-LOW' THEN 'low' WHEN '4-NOT SPECIFIED' THEN 'medium' ELSE 'high' END AS confidence,
     CASE o_orderpriority WHEN '5-LOW' THEN 'high' WHEN '4-NOT SPECIFIED' THEN 'medium' ELSE 'low' END AS risk_level, o_orderpriority = '5-LOW' AS requires_confirmation,
     CAST(o_orderkey % 40 + 1 AS VARCHAR) AS r FROM orders),
  ovr AS (SELECT o_custkey AS job_id, 'map_' || o_orderkey AS mapping_id, o_orderkey % 10 <> 0 AS enabled, CASE WHEN o_orderkey % 15 = 0 THEN 'nosheet' WHEN o_orderkey % 25 = 0 THEN 'S2' END AS osheet,
     CASE WHEN o_orderkey % 35 = 0 THEN 'E5' END AS ocell, CASE WHEN o_orderkey % 4 = 0 THEN 'force_overwrite' ELSE 'only_empty' END AS opolicy,
     least(greatest(o_orderkey % 7 - 1, 0), 2) AS oi FROM orders WHERE o_orderkey % 5 = 0),
  joined AS (SELECT c.*, enabled, opolicy, coalesce(osheet, CASE WHEN coalesce(oi, 0) = 2 THEN 'S2' ELSE 'S1' END) AS msheet,
     coalesce(ocell, ['B', 'C', 'D'][coalesce(oi, 0) + 1] || r) AS mcell FROM cand c LEFT JOIN ovr USING (job_id, mapping_id)),
  decided AS (SELECT *, msheet IN ('S1', 'S2') AS target_valid, CASE WHEN enabled IS NULL THEN 'auto' WHEN NOT enabled THEN 'manual_mapping_skipped'
     WHEN msheet IN ('S1', 'S2') THEN 'manual' ELSE 'invalid_manual_mapping' END AS decision FROM joined),
  decisions AS (SELECT job_id, mapping_id, map_idx, metric, value, requires_confirmation, target_valid, decision, CASE WHEN decision = 'manual' THEN opolicy ELSE 'only_empty' END AS write_policy,
     CASE WHEN decision IN ('manual', 'auto') THEN msheet ELSE 'S1' END AS target_sheet, CASE WHEN decision IN ('manual', 'auto') THEN mcell ELSE 'B' || r END AS target_cell FROM decided),
  actions AS (SELECT *, CASE WHEN decision = 'manual_mapping_skipped' THEN 'skipped' WHEN decision = 'manual' THEN 'write' WHEN requires_confirmation AND decision = 'auto' THEN 'requires_confirmation'
     WHEN bool_or(requires_confirmation AND decision = 'auto') OVER (PARTITION BY job_id) THEN 'held_back' WHEN requires_confirmation THEN 'requires_confirmation' ELSE 'write' END AS action FROM decisions)"""
GRID = """
  grid AS (SELECT c_custkey AS job_id, 'S1' AS sheet, c_custkey % 40 + 1 AS row_idx, 2 AS col_idx, '600' AS value_str FROM customer
     UNION ALL SELECT c_custkey, 'S1', c_custkey % 40 + 1, 3, '-' FROM customer)"""
WRITES = f"""
  targets AS (SELECT job_id, mapping_id, map_idx, target_sheet AS sheet, CAST(regexp_extract(target_cell, '[0-9]+') AS BIGINT) AS row_idx, ascii(target_cell) - 64 AS col_idx, 'result' AS field, value, write_policy, decision
     FROM actions WHERE action = 'write'),
  sides AS (SELECT job_id, mapping_id, map_idx, target_sheet, CAST(regexp_extract(target_cell, '[0-9]+') AS BIGINT), f.c, f.field, CASE f.field WHEN 'metric' THEN metric ELSE 'o_totalprice' END, write_policy, decision
     FROM actions, (VALUES ('column', 7), ('metric', 8)) AS f(field, c) WHERE action = 'write' AND target_sheet = 'S1'),
  writes AS (SELECT * FROM targets UNION ALL SELECT * FROM sides),
  firsts AS (SELECT *, min(CASE WHEN NOT {Q.is_empty_like('value')} THEN map_idx END) OVER w AS first_idx, first_value(value) OVER (PARTITION BY job_id, sheet, row_idx, col_idx ORDER BY map_idx) AS first_value
     FROM writes WINDOW w AS (PARTITION BY job_id, sheet, row_idx, col_idx)),
  seen AS (SELECT f.*, CASE WHEN {Q.is_empty_like('value_str')} AND first_idx < map_idx THEN first_value ELSE value_str END AS existing_value,
     sheet = 'S2' AND row_idx BETWEEN 1 AND 20 AND col_idx BETWEEN 4 AND 5 AND NOT (row_idx = 1 AND col_idx = 4) AS blocked
     FROM firsts f LEFT JOIN grid USING (job_id, sheet, row_idx, col_idx)),
  audit AS (SELECT job_id, mapping_id, map_idx, sheet, row_idx, col_idx, chr(CAST(64 + col_idx AS INTEGER)) || row_idx AS cell, field,
     CASE WHEN blocked THEN 'blocked_merged_cell' WHEN value IS NULL OR value = '' THEN 'source_empty' WHEN write_policy = 'force_overwrite' THEN 'written' WHEN {Q.is_empty_like('existing_value')} THEN 'written'
          WHEN {Q.loose_equal('existing_value', 'value')} THEN 'kept_existing' ELSE 'preserved_existing' END AS status,
     value, existing_value, write_policy, CASE WHEN decision = 'manual' THEN 'manual' ELSE 'auto' END AS decision_source FROM seen)"""


def actions(spark, folder):
    return L.gate_candidates(L.apply_overrides(candidates(spark, folder), overrides(spark, folder), job_sheets(spark, folder)))


def grid_cells(spark, folder):
    customer = table(spark, folder, "customer")
    return customer.select(
        F.col("c_custkey").alias("job_id"), F.lit("S1").alias("sheet"), (F.col("c_custkey") % 40 + 1).alias("row_idx"),
        F.explode(F.array(F.struct(F.lit(2).alias("col_idx"), F.lit("600").alias("value_str")), F.struct(F.lit(3).alias("col_idx"), F.lit("-").alias("value_str")))).alias("c"),
    ).select("job_id", "sheet", "row_idx", "c.*")


def candidate_audit(spark, folder):
    customer = table(spark, folder, "customer")
    merged = customer.select(
        F.col("c_custkey").alias("job_id"), F.lit("S2").alias("sheet"), *[F.lit(v).alias(n) for n, v in (("min_row", 1), ("max_row", 20), ("min_col", 4), ("max_col", 5))]
    )
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(c).alias("col_idx")) for n, c in (("column", 7), ("metric", 8))])).alias("f")
    layouts = customer.select(F.col("c_custkey").alias("job_id"), F.lit("S1").alias("sheet"), fields).select("job_id", "sheet", "f.*")
    return L.write_candidates(actions(spark, folder), grid_cells(spark, folder), merged, layouts)


def shared_audit(spark, folder, *columns: str):
    """Columns of the audit for queries that read it several times: its joins run once, and not side by side in one task."""
    return store(candidate_audit(spark, folder).select(*columns))


def register(catalog: Catalog) -> None:
    @catalog.add(
        f"SELECT c_custkey AS pair_id, s AS source_header, t AS target_header, c AS target_col, score::DOUBLE AS score FROM customer JOIN (VALUES {_values(EXPECTED)}) AS e(v, s, t, c, score) ON c_custkey % 4 = v"
    )
    def header_match(spark, folder):
        """One-to-one header mapping of each pair."""
        return L.match_headers(header_pairs(spark, folder))

    @catalog.add(
        f"SELECT c_custkey AS pair_id, s AS source_header, t AS target_header, c AS target_col, p AS priority FROM customer JOIN (VALUES {_values(EXPECTED_KEYS)}) AS e(v, s, t, c, p) ON c_custkey % 4 = v"
    )
    def key_choice(spark, folder):
        """Key mapping of each pair."""
        return L.choose_key(L.match_headers(header_pairs(spark, folder)))

    @catalog.add(
        """SELECT c_custkey AS pair_id, CASE WHEN c_custkey % 4 = 3 THEN 'header_mapping' WHEN c_custkey % 8 < 4 THEN 'keyed_blank_fill' ELSE 'header_mapping' END AS mode,
           CASE WHEN c_custkey % 10 = 0 THEN 'blocked_by_crosscheck' END AS status FROM customer"""
    )
    def transfer_mode(spark, folder):
        """Mode of each pair, and the pairs a review blocks."""
        pairs = header_pairs(spark, folder)
        mappings = L.match_headers(pairs)
        matched = pairs.where("pair_id % 8 < 4").select("pair_id")
        return L.transfer_mode(pairs, mappings, L.choose_key(mappings), matched, pairs.where("pair_id % 10 = 0"))

    @catalog.add(f"WITH {SOURCE}, {TARGET} {KEYED_AUDIT}")
    def keyed_fill(spark, folder):
        """Audit of filling customers from their orders: every order is an attempt on two cells."""
        return keyed(spark, folder).audit()

    @catalog.add(
        f"""
        WITH {SOURCE}, {TARGET}, a AS ({KEYED_AUDIT}),
        f0 AS (SELECT o_custkey, arg_min(v0, o_orderkey) FILTER (NOT {Q.is_empty_like('v0')}) AS n0, arg_min(v1, o_orderkey) FILTER (NOT {Q.is_empty_like('v1')}) AS n1,
               arg_max(v1, o_orderkey) FILTER (v1 IS NOT NULL) AS l1 FROM s GROUP BY o_custkey)
        SELECT c_custkey, CAST(CASE WHEN {Q.is_empty_like('x0')} THEN coalesce(n0, x0) ELSE x0 END AS DOUBLE) AS balance,
               CASE WHEN {Q.is_empty_like('x1')} THEN coalesce(n1, l1, x1) ELSE x1 END AS note FROM t LEFT JOIN f0 ON o_custkey = c_custkey"""
    )
    def keyed_filled(spark, folder):
        """The customer table after the fill."""
        return keyed(spark, folder).filled()

    @catalog.add(
        f"""
        WITH {SOURCE}, {TARGET}, a AS ({KEYED_AUDIT})
        SELECT target_col, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'kept_existing') AS kept_existing, count(*) FILTER (status = 'preserved_existing') AS preserved_existing,
               count(*) FILTER (status = 'source_empty') AS source_empty, count(DISTINCT CASE WHEN status = 'written' THEN target_row END) AS rows_transferred FROM a GROUP BY target_col"""
    )
    def audit_stats(spark, folder):
        """Audit of the keyed fill by status."""
        stats = L.audit_stats(keyed(spark, folder).audit(), ["target_col"], "target_row")
        return stats.select("target_col", "written", "kept_existing", "preserved_existing", "source_empty", "rows_transferred")

    @catalog.add(
        """
        WITH tgt AS (SELECT c_nationkey AS nation, c_custkey AS r, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS name, CASE WHEN c_custkey % 6 = 1 THEN c_acctbal END AS bal FROM customer),
        free AS (SELECT nation, r, row_number() OVER (PARTITION BY nation ORDER BY r) AS n FROM tgt WHERE name IS NULL AND bal IS NULL),
        facts AS (SELECT nation, max(r) AS last, count(*) FILTER (name IS NULL AND bal IS NULL) AS free FROM tgt GROUP BY nation),
        src AS (SELECT s_nationkey AS nation, s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS v0, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_acctbal AS VARCHAR) END AS v1,
                row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
        p AS (SELECT s.*, coalesce(f.r, last + s.n - free) AS target_row FROM src s JOIN facts USING (nation) LEFT JOIN free f ON f.nation = s.nation AND f.n = s.n)
        SELECT nation, s_suppkey AS source_row, target_row, 1 AS col_idx, 's_name' AS source_col, 'name' AS target_col, CASE WHEN v0 IS NULL THEN 'source_empty' ELSE 'written' END AS status,
               v0 AS value, NULL AS existing_value, 'A' || target_row AS cell FROM p
        UNION ALL SELECT nation, s_suppkey, target_row, 2, 's_acctbal', 'bal', CASE WHEN v1 IS NULL THEN 'source_empty' ELSE 'written' END, v1, NULL, 'B' || target_row FROM p"""
    )
    def append_rows(spark, folder):
        """Suppliers placed into the blank rows of the customers of their nation, the rest below."""
        key = F.col("c_custkey")
        target = table(spark, folder, "customer").select(
            F.col("c_nationkey").alias("nation"), key.alias("r"), F.when(key % 2 == 1, F.col("c_name")).alias("name"), F.when(key % 6 == 1, F.col("c_acctbal")).alias("bal")
        )
        source = table(spark, folder, "supplier").select(
            F.col("s_nationkey").alias("nation"), "s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_name")).alias("s_name"),
            F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("s_acctbal"),
        )
        return L.append_rows(source, target, ["nation"], [("s_name", "name", 1.0), ("s_acctbal", "bal", 1.0)], "s_suppkey", "r")

    @catalog.add(
        f"""
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS VARCHAR) END AS value,
            CASE o_orderkey % 5 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN '-' WHEN 2 THEN '0' WHEN 3 THEN '¥' || CAST(o_totalprice AS VARCHAR) END AS existing,
            CASE WHEN o_orderkey % 3 = 0 THEN 'force_overwrite' ELSE 'only_empty' END AS policy FROM orders)
        SELECT o_orderkey, CASE WHEN value IS NULL THEN 'source_empty' WHEN policy = 'force_overwrite' THEN 'written' WHEN {Q.is_empty_like('existing')} THEN 'written'
               WHEN {Q.loose_equal('existing', 'value')} THEN 'kept_existing' ELSE 'preserved_existing' END AS status FROM o"""
    )
    def write_policy(spark, folder):
        """Status of one write per order under three policies."""
        key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
        existing = F.when(key % 5 == 0, price).when(key % 5 == 1, "-").when(key % 5 == 2, "0").when(key % 5 == 3, F.concat(F.lit("¥"), price))
        policy = L.write_policy(F.when(key % 3 == 0, "force_overwrite").when(key % 3 == 1, "allow_same").otherwise("?"))
        df = table(spark, folder, "orders").select("o_orderkey", F.when(key % 7 != 0, price).alias("value"), existing.alias("existing"), policy.alias("policy"))
        return df.select("o_orderkey", L.write_status(F.col("value"), F.col("existing"), F.col("policy")).alias("status"))

    @catalog.add(
        """
        WITH m AS (SELECT DISTINCT user_id AS doc_id, event_type AS sheet, hour(ts) * 10 AS min_row, hour(ts) * 10 + 3 AS max_row, 2 AS min_col, 3 AS max_col FROM events),
        t AS (SELECT event_id, user_id AS doc_id, event_type AS sheet, minute(ts) * 4 AS row_idx, event_id % 5 AS col_idx FROM events)
        SELECT event_id, doc_id, sheet, row_idx, col_idx, EXISTS (SELECT 1 FROM m WHERE m.doc_id = t.doc_id AND m.sheet = t.sheet AND row_idx BETWEEN min_row AND max_row AND col_idx BETWEEN min_col AND max_col
            AND NOT (row_idx = min_row AND col_idx = min_col)) AS blocked FROM t"""
    )
    def merged_guard(spark, folder):
        """Which target cells lie in a merged range without being its first cell."""
        events = table(spark, folder, "events")
        hour = F.hour("ts") * 10
        merged = events.select(
            F.col("user_id").alias("doc_id"), F.col("event_type").alias("sheet"), hour.alias("min_row"), (hour + 3).alias("max_row"), F.lit(2).alias("min_col"), F.lit(3).alias("max_col")
        ).distinct()
        targets = events.select(
            "event_id", F.col("user_id").alias("doc_id"), F.col("event_type").alias("sheet"), (F.minute("ts") * 4).alias("row_idx"), (F.col("event_id") % 5).alias("col_idx")
        )
        return L.in_merged_range(targets, merged)

    @catalog.add(
        """
        WITH dup AS (SELECT c_nationkey AS job_id, c_mktsegment AS metric, count(*) AS n, min(c_custkey) AS k FROM customer GROUP BY ALL),
        rws AS (SELECT job_id, k AS map_idx, metric FROM dup UNION ALL SELECT job_id, k + 1000000000, metric FROM dup WHERE k % 3 = 0 UNION ALL SELECT job_id, k + 2000000000, 'x' || metric FROM dup WHERE k % 2 = 0),
        tmpl AS (SELECT c_nationkey AS job_id, c_mktsegment AS metric, max(c_custkey) AS metric_row FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL),
        sh AS (SELECT c_nationkey AS job_id, max(c_custkey) AS max_row FROM customer GROUP BY ALL),
        one AS (SELECT job_id, metric FROM rws GROUP BY ALL HAVING count(*) = 1),
        f AS (SELECT r.*, t.metric_row FROM rws r LEFT JOIN (tmpl JOIN one USING (job_id, metric)) t USING (job_id, metric)),
        a AS (SELECT *, sum(CASE WHEN metric_row IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY map_idx) AS added FROM f)
        SELECT job_id, map_idx, metric, 'T' AS sheet, CAST(coalesce(metric_row, max_row + added) AS BIGINT) AS target_row, 'B' || CAST(coalesce(metric_row, max_row + added) AS BIGINT) AS cell,
          CASE WHEN metric_row IS NULL THEN 'append_row' ELSE 'matched_existing_metric' END AS status, CASE WHEN metric_row IS NULL THEN 'medium' ELSE 'high' END AS confidence,
          CASE WHEN metric_row IS NULL THEN 0.71 ELSE 0.94 END::DOUBLE AS score, CASE WHEN metric_row IS NULL THEN 'medium' ELSE 'low' END AS risk_level,
          CASE WHEN metric_row IS NOT NULL THEN 'B' || CAST(greatest(max_row + added + 1, metric_row + 1) AS BIGINT) END AS alternative_cell
        FROM a JOIN sh USING (job_id)"""
    )
    def metric_row_match(spark, folder):
        """Target row of each result row in a template with metric and result columns."""
        customer = table(spark, folder, "customer")
        job, metric, key = F.col("c_nationkey").alias("job_id"), F.col("c_mktsegment").alias("metric"), F.col("c_custkey")
        base = customer.groupBy(job, metric).agg(F.min("c_custkey").alias("k"))
        copy = F.array_compact(F.array(
            F.struct(F.col("k").alias("map_idx"), F.col("metric").alias("metric")),
            F.when(F.col("k") % 3 == 0, F.struct((F.col("k") + 1000000000).alias("map_idx"), F.col("metric").alias("metric"))),
            F.when(F.col("k") % 2 == 0, F.struct((F.col("k") + 2000000000).alias("map_idx"), F.concat(F.lit("x"), "metric").alias("metric"))),
        ))
        rows = base.select("job_id", F.explode(copy).alias("r")).select("job_id", "r.*")
        template = customer.where(key % 2 == 0).select(job, key.alias("row_idx"), metric)
        sheets = customer.groupBy(job).agg(F.max("c_custkey").alias("max_row")).select(
            "job_id", F.lit("T").alias("sheet"), "max_row", F.lit(1).alias("header_row"), F.lit(2).alias("result_col")
        )
        return L.match_metric_rows(rows, template, sheets)

    @catalog.add(f"WITH {CANDIDATES} SELECT job_id, mapping_id, decision, target_sheet, target_cell, write_policy, target_valid FROM decisions")
    def override_merge(spark, folder):
        """Decision and target of each candidate with its override."""
        df = L.apply_overrides(candidates(spark, folder), overrides(spark, folder), job_sheets(spark, folder))
        return df.select("job_id", "mapping_id", "decision", "target_sheet", "target_cell", "write_policy", "target_valid")

    @catalog.add(f"WITH {CANDIDATES} SELECT job_id, mapping_id, action FROM actions")
    def candidate_gate(spark, folder):
        """What happens to each candidate; one unconfirmed candidate holds back its job."""
        return actions(spark, folder).select("job_id", "mapping_id", "action")

    @catalog.add(f"WITH {CANDIDATES}, {GRID}, {WRITES} SELECT * FROM audit")
    def candidate_writes(spark, folder):
        """Audit of the candidate writes with their side columns."""
        return candidate_audit(spark, folder)

    @catalog.add(
        f"""WITH {CANDIDATES}, {GRID}, {WRITES}, ok AS (SELECT DISTINCT job_id FROM audit WHERE status IN ('written', 'kept_existing', 'preserved_existing'))
        SELECT job_id, mapping_id, sheet, cell, status, value FROM audit WHERE job_id IN (SELECT job_id FROM ok)
        UNION ALL SELECT c_custkey, NULL, '结果表', NULL, 'result_sheet_created', NULL FROM customer WHERE c_custkey NOT IN (SELECT job_id FROM ok)"""
    )
    def finished_jobs(spark, folder):
        """Audit of each job; a job without any write gets a result sheet."""
        audit = shared_audit(spark, folder, "job_id", "mapping_id", "sheet", "cell", "status", "value")
        return L.finish_jobs(audit, table(spark, folder, "customer").select(F.col("c_custkey").alias("job_id")))

    @catalog.add(
        f"""WITH {CANDIDATES}, {GRID}, {WRITES},
        ok AS (SELECT DISTINCT job_id FROM audit WHERE status IN ('written', 'kept_existing', 'preserved_existing')),
        rws AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY map_idx) AS n FROM cand)
        SELECT a.job_id, a.mapping_id, a.status, a.sheet AS target_sheet, a.cell AS target_cell, c.metric, a.value FROM audit a JOIN ok USING (job_id) JOIN cand c ON c.job_id = a.job_id AND c.mapping_id = a.mapping_id
        UNION ALL SELECT job_id, '', 'result_sheet_written', '结果表', 'G' || (n + 1), metric, value FROM rws
          WHERE job_id NOT IN (SELECT job_id FROM ok) AND job_id % 2 = 0
        UNION ALL SELECT job_id, 'row_' || n, 'not_written', '', '', metric, value FROM rws WHERE job_id NOT IN (SELECT job_id FROM ok) AND job_id % 2 = 1"""
    )
    def fill_report(spark, folder):
        """Report rows of each job; jobs without a write have a result sheet (even) or nothing (odd)."""
        customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("job_id"))
        shared = shared_audit(spark, folder, "job_id", "mapping_id", "sheet", "cell", "status", "value")
        done = L.finish_jobs(shared, customer.where("job_id % 2 = 0")).where("status <> 'result_sheet_created' OR job_id % 2 = 0")
        rows = candidates(spark, folder).select("job_id", "mapping_id", "map_idx", "metric", "value", F.lit(7).alias("result_col"))
        audit = done.join(rows.select("job_id", "mapping_id", "metric"), ["job_id", "mapping_id"], "left")
        return L.fill_report(audit, rows)

    @catalog.add(
        f"""WITH {CANDIDATES}, {GRID}, {WRITES}, outp AS (SELECT job_id, sheet, row_idx, col_idx, CASE WHEN job_id % 4 = 0 THEN 'lost' WHEN job_id % 4 = 1 THEN value || '.0' ELSE value END AS actual
             FROM (SELECT *, row_number() OVER (PARTITION BY job_id, sheet, row_idx, col_idx ORDER BY map_idx) AS rn FROM audit WHERE field = 'result' AND status = 'written') WHERE rn = 1 AND job_id % 5 <> 0)
        SELECT a.job_id, a.mapping_id, a.cell, a.status, o.actual, coalesce(o.actual IS NOT NULL AND
               (CASE WHEN regexp_matches(lower(o.actual), '^-?[0-9]+\\.0+$') THEN regexp_replace(lower(o.actual), '\\.0+$', '') ELSE lower(o.actual) END)
             = (CASE WHEN regexp_matches(lower(a.value), '^-?[0-9]+\\.0+$') THEN regexp_replace(lower(a.value), '\\.0+$', '') ELSE lower(a.value) END), false) AS passed
        FROM audit a LEFT JOIN outp o USING (job_id, sheet, row_idx, col_idx) WHERE a.field = 'result' AND a.status IN ('written', 'kept_existing')"""
    )
    def fill_validate(spark, folder):
        """Written cells compared with a re-read grid in which some cells are missing or changed."""
        target = ["job_id", "sheet", "row_idx", "col_idx"]
        audit = shared_audit(spark, folder, *target, "mapping_id", "map_idx", "cell", "field", "status", "value")
        changed = F.when(F.col("job_id") % 4 == 0, "lost").when(F.col("job_id") % 4 == 1, F.concat("value", F.lit(".0"))).otherwise(F.col("value"))
        output = (
            audit.where("field = 'result' AND status = 'written' AND job_id % 5 <> 0").withColumn("value_str", changed)
            .groupBy(*target).agg(F.min_by("value_str", "map_idx").alias("value_str"))
        )
        return L.validate_fill(audit, output, target).select("job_id", "mapping_id", "cell", "status", "actual", "passed")

    review_sql = """
        WITH c AS (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '5-LOW' THEN 'low' WHEN '4-NOT SPECIFIED' THEN 'medium' ELSE 'high' END AS confidence,
             CASE o_orderpriority WHEN '5-LOW' THEN 'high' WHEN '4-NOT SPECIFIED' THEN 'medium' ELSE 'low' END AS risk_level FROM orders),
        v AS (SELECT event_id, value > 5 AS approved, CASE WHEN event_type IN ('click', 'view') THEN 'low' WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS rr, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS issue FROM events),
        j AS (SELECT c.*, v.*, coalesce(rr = 'high' OR NOT approved, false) AS flagged FROM c LEFT JOIN v ON event_id = o_orderkey)"""

    def verdicts(spark, folder):
        kind = F.col("event_type")
        return table(spark, folder, "events").join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("event_id") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("job_id"), F.concat(F.lit("map_"), "event_id").alias("mapping_id"), (F.col("value") > 5).alias("approved"),
            F.when(kind.isin("click", "view"), "low").when(kind == "error", "HIGH ").otherwise("unclear").alias("risk_level"),
            F.when(F.col("event_id") % 2 == 0, kind).alias("issue"), F.lit("S1").alias("suggested_sheet"), F.lit("b3").alias("suggested_cell"),
        )

    @catalog.add(
        review_sql + """
        SELECT o_custkey AS job_id, 'map_' || o_orderkey AS mapping_id, CASE WHEN flagged THEN 'review_flagged' ELSE 'matched_label' END AS status, CASE WHEN flagged THEN 'low' ELSE confidence END AS confidence,
               CASE WHEN flagged THEN 'high' WHEN rr = 'medium' AND risk_level = 'low' THEN 'medium' ELSE risk_level END AS risk_level, flagged OR confidence = 'low' AS requires_confirmation,
               'label' || CASE WHEN issue <> '' THEN '；Review 交叉检查：' || issue ELSE '' END AS reasons, CASE WHEN rr IS NOT NULL THEN 'B3' END AS review_suggested_cell FROM j"""
    )
    def review_merge(spark, folder):
        """Candidates with the verdicts of a review."""
        merged = L.merge_reviews(candidates(spark, folder), verdicts(spark, folder))
        return merged.select(
            "job_id", "mapping_id", "status", "confidence", "risk_level", "requires_confirmation", F.array_join("reasons", "；").alias("reasons"), "review_suggested_cell"
        )

    @catalog.add(
        review_sql + """
        SELECT o_custkey AS job_id, 'map_' || o_orderkey AS mapping_id FROM j WHERE (flagged OR confidence = 'low') AND o_orderkey % 5 <> 0"""
    )
    def unconfirmed(spark, folder):
        """Candidates that need confirmation after the review and have no override."""
        merged = L.merge_reviews(candidates(spark, folder), verdicts(spark, folder))
        return L.unconfirmed(merged, overrides(spark, folder)).select("job_id", "mapping_id")

    @catalog.add(
        """
        SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalid_response' ELSE 'completed' END AS review_status,
          CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'click' THEN 'high' ELSE 'medium' END AS risk_level,
          event_type IN ('error', 'click') AS block, CASE WHEN event_type IN ('error', 'click') THEN 'blocked_by_crosscheck' END AS audit_status,
          CASE WHEN event_type = 'error' THEN '' ELSE event_type || '；b' END AS reason FROM events"""
    )
    def block_gate(spark, folder):
        """Verdict of each reply and whether it blocks the job."""
        kind = F.col("event_type")
        risk = F.when(kind == "click", "High").otherwise("n/a")
        reply = F.concat(F.lit('{"riskLevel": "'), risk, F.lit('", "issues": ["'), kind, F.lit('", " b ", "b"]'), F.when(kind == "error", "").otherwise("}"))
        jobs = table(spark, folder, "events").select("event_id", reply.alias("reply"))
        return L.block_gate(jobs, "reply").select("event_id", "review_status", "risk_level", "block", "audit_status", "reason")

    @catalog.add(
        f"""WITH {CANDIDATES}, {GRID}, {WRITES}, u AS (SELECT job_id, mapping_id, field, status, CASE decision_source WHEN 'manual' THEN 'manual_mapping' ELSE 'label_value' END AS mode FROM audit),
        m AS (SELECT job_id, CASE WHEN bool_or(mode = 'manual_mapping') AND bool_or(mode = 'label_value') THEN 'manual_mapping+label_value' ELSE any_value(mode) END AS mode FROM u GROUP BY job_id)
        SELECT u.job_id, u.status, m.mode, count(*) AS n FROM u JOIN m USING (job_id) GROUP BY ALL"""
    )
    def audit_union(spark, folder):
        """Manual and automatic audits as one, with the joint mode of each job."""
        audit = shared_audit(spark, folder, "job_id", "status", "decision_source")
        manual = audit.where("decision_source = 'manual'").withColumn("mode", F.lit("manual_mapping"))
        auto = audit.where("decision_source = 'auto'").withColumn("mode", F.lit("label_value"))
        union, modes = L.audit_union(manual, auto, ["job_id"])
        # Counted before the join, so that a row per job and status meets its mode.
        counts = union.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(modes, "job_id").select("job_id", "status", "mode", "n")
