"""Matching template labels with result rows, value positions and candidate ranking.

A label matches the one result row with the best score: points for its metric plus points for every
context field (group value, column, group column, sheet) that the label names. A tie for the first
place means no match.

No label is paired with all result rows of its job. The result rows are indexed by metric and by every
subset of their context fields, in a fixed order of fields: a trie whose nodes hold row counts. A label walks
down field by field: the nodes it has reached are joined with the values it names of the next field, and only
nodes that exist go on. The values themselves are found by an equi-join on exact substrings.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators.fill import risk_of
from gridweave.operators.scaling import attach, find_tokens
from gridweave.rules import fixed

FIELDS = list(fixed.LABEL_CONTEXT_WEIGHTS)
LABEL = ["job_id", "sheet", "row_idx", "col_idx"]


def metric_hits(token: str) -> Column:
    """Metrics a label token names, with their points: 70 if it is an alias, else 46 plus the longest alias it holds."""
    cases = []
    for metric, words in fixed.LABEL_METRIC_ALIASES.items():
        aliases = sorted({S.py_token(w) for w in [metric, *words]})
        sizes = [f"CASE WHEN contains({token}, {S.sql_text(a)}) THEN {len(a)} ELSE 0 END" for a in aliases if len(a) >= 2]
        held = f"greatest({', '.join(sizes)})"
        cases.append(
            f"CASE WHEN {token} IN ({S.sql_list(aliases)}) THEN named_struct('metric', '{metric}', 'points', {fixed.LABEL_EXACT_SCORE}, 'exact', true) "
            f"WHEN {held} > 0 THEN named_struct('metric', '{metric}', 'points', {fixed.LABEL_CONTAINED_SCORE} + {held}, 'exact', false) END"
        )
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def context_tokens(value: str) -> Column:
    """Tokens by which a label may name a field value: its own token and those of its alias family."""
    token = S.norm_token_sql(value)
    families = []
    for name, words in fixed.LABEL_CONTEXT_ALIASES.items():
        aliases = sorted({S.py_token(w) for w in words})
        families.append(f"CASE WHEN {token} IN ({S.sql_list([name, *aliases])}) THEN array({S.sql_list(aliases)}) ELSE array() END")
    every = f"array_distinct(concat(array({token}), {', '.join(families)}))"
    return F.expr(f"filter({every}, t -> length(t) >= 2 AND t NOT IN ({S.sql_list(fixed.LABEL_CONTEXT_IGNORED)}))")


def is_title_label(cells: DataFrame) -> Column:
    """A lone cell near the top left with a title word and no metric word (needs `row_filled`, cells in its row)."""
    title = S.contains_any("value_str", fixed.TITLE_LABEL_HINTS) & ~S.contains_any("value_str", fixed.TITLE_LABEL_METRIC_WORDS)
    return (F.col("row_idx") <= 2) & (F.col("col_idx") <= 2) & (F.col("row_filled") <= 1) & title


def label_cells(cells: DataFrame) -> DataFrame:
    """Cells that may be labels: text with a metric word, without titles. Row counts are needed for two rows per sheet only."""
    top = cells.where("row_idx <= 2").groupBy("job_id", "sheet", "row_idx").agg(F.count(F.lit(1)).alias("row_filled"))
    named = cells.withColumn("token", S.norm_token("value_str")).withColumn("hits", metric_hits("token")).where("size(hits) > 0")
    return named.join(top, ["job_id", "sheet", "row_idx"], "left").where(~F.coalesce(is_title_label(cells), F.lit(False))).drop("row_filled")


def within_scan_bounds(cells: DataFrame, rows: DataFrame, most_rows: int | None = None, most_columns: int | None = None) -> DataFrame:
    """Optional: only cells in the area a scan sized by the result rows would visit; `most_rows` and `most_columns` bound it further."""
    capped = lambda value, most: value if most is None else F.least(value, F.lit(most))
    size = cells.groupBy("job_id", "sheet").agg(F.max("row_idx").alias("__r"), F.max("col_idx").alias("__c"))
    count = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("__n"))
    bounds = size.join(count, "job_id", "left").na.fill(0, ["__n"]).select(
        "job_id", "sheet",
        capped(F.least(F.col("__r") + 3, F.greatest(F.lit(fixed.SCAN_ROW_BASE), F.col("__n") * 2 + 10)), most_rows).alias("__rows"),
        capped(F.col("__c") + 3, most_columns).alias("__cols"),
    )
    return attach(cells, bounds, ["job_id", "sheet"], "inner").where("row_idx <= __rows AND col_idx <= __cols").drop("__rows", "__cols")


def _entry_key(parts: Sequence[Column]) -> Column:
    return F.concat_ws("\x01", *parts)


def row_index(rows: DataFrame) -> DataFrame:
    """Result rows by job, metric and node of the trie (the chosen fields in order): how many, and the first one.

    All aggregates are numbers, so rows are combined by hash before they move.
    """
    keys = []
    for size in range(len(FIELDS) + 1):
        for subset in combinations(FIELDS, size):
            present = F.lit(True)
            for f in subset:
                present = present & (F.coalesce(F.col(_row_field(f)), F.lit("")) != "")
            key = _entry_key([F.concat(F.lit(f + "="), F.col(_row_field(f))) for f in subset]) if subset else F.lit("")
            keys.append(F.when(present, key))
    return (
        rows.select("job_id", "metric", F.col("map_idx").cast("bigint").alias("map_idx"), F.explode_outer(F.array_compact(F.array(*keys))).alias("entry"))
        .groupBy("job_id", "metric", "entry")
        .agg(F.count(F.lit(1)).alias("row_count"), F.min("map_idx").alias("map_idx"))
    )


def _row_field(field: str) -> str:
    return "source_sheet" if field == "sheet" else field


def named_values(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Context field values that a label names (label keys, field, field_value)."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(_row_field(f)).alias("field_value")) for f in FIELDS])
    values = rows.select("job_id", F.explode(fields).alias("v")).select("job_id", "v.*").where("field_value IS NOT NULL AND field_value <> ''").distinct()
    vocabulary = values.withColumn("word", F.explode_outer(context_tokens("field_value")))
    return find_tokens(labels.select(*LABEL, "token"), "token", vocabulary, "word", ["job_id"]).select(*LABEL, "field", "field_value").distinct()


def match_labels(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """The result row of each label, if there is exactly one with the best score.

    `labels`: output of `label_cells`. `rows`: job_id, mapping_id, map_idx, metric, group_value, column,
    group_col, source_sheet. Matching is stateless: one result row may match several labels. The rows of a
    label at any step are nodes that exist in the index, however many values it names.
    """
    index = row_index(rows)
    named = named_values(labels, rows).groupBy(*LABEL).agg(
        # A label names few values of a field: at most one per substring of its text.
        *[F.collect_list(F.when(F.col("field") == f, F.concat(F.col("field"), F.lit("="), F.col("field_value")))).alias(f"__{f}") for f in FIELDS]
    )
    arrays = [f"__{f}" for f in FIELDS]
    begun = labels.select(*LABEL, F.col("value_str").alias("label"), "hits").join(named, LABEL, "left")
    reached = begun.select(*LABEL, "label", *arrays, F.explode_outer("hits").alias("h")).select(*LABEL, "label", *arrays, "h.*", F.lit("").alias("entry"), F.lit(0).alias("weight"))
    for field in FIELDS:
        # Each node goes on as it is and once for each named value; what does not exist ends here.
        steps = F.array_append(F.coalesce(f"__{field}", S.string_array([])), F.lit(None).cast("string"))
        further = reached.withColumn("step", F.explode_outer(steps)).select(
            *[c for c in reached.columns if c not in ("entry", "weight", "row_count", "map_idx", f"__{field}")],
            F.when(F.col("step").isNull(), F.col("entry")).otherwise(_entry_key([F.nullif("entry", F.lit("")), F.col("step")])).alias("entry"),
            (F.col("weight") + F.when(F.col("step").isNull(), 0).otherwise(fixed.LABEL_CONTEXT_WEIGHTS[field])).alias("weight"),
        )
        reached = attach(further, index, ["job_id", "metric", "entry"], "inner")
    found = reached.where("exact OR weight > 0").withColumn("score", F.col("points") + F.col("weight"))
    levels = found.groupBy(*LABEL, "label", "score").agg(F.sum("row_count").alias("rows"), F.min("map_idx").alias("map_idx"))
    best = levels.groupBy(*LABEL, "label").agg(F.max(F.struct("score", "rows", "map_idx")).alias("b"))
    first = best.where("b.rows = 1").select(*LABEL, "label", F.col("b.map_idx").alias("map_idx"), F.col("b.score").alias("score"))
    return attach(first, rows.select("job_id", F.col("map_idx").cast("bigint").alias("map_idx"), "mapping_id"), ["job_id", "map_idx"], "inner").select(*LABEL, "label", "mapping_id", "score")


def one_label_per_row(matches: DataFrame, keys: Sequence[str] = ("job_id", "mapping_id")) -> DataFrame:
    """When filling, the first label of a result row (in row-major order) takes it."""
    first = Window.partitionBy(*keys).orderBy("row_idx", "col_idx")
    return matches.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def looks_like_label(text: str) -> Column:
    """Is a cell text a known header, a metric alias, or does it hold a metric alias of two characters or more?"""
    token = S.norm_token_sql(text)
    aliases = sorted({S.py_token(w) for words in fixed.LABEL_METRIC_ALIASES.values() for w in words})
    headers = sorted({S.py_token(h) for h in fixed.FILL_HEADER_ALIASES})
    held = S.contains_any_sql(token, [a for a in aliases if len(a) >= 2])
    return F.expr(f"({token} <> '' AND ({token} IN ({S.sql_list([*headers, *aliases])}) OR {held}))")


def value_positions(matches: DataFrame, cells: DataFrame) -> DataFrame:
    """Places for the value of each matched label with score and confidence: right 1 to 3, then down 1 to 2.

    Places with a label are skipped, places with another value lose points.
    """
    size = cells.groupBy("job_id", "sheet").agg(F.max("row_idx").alias("__rows"), F.max("col_idx").alias("__cols"))
    places = F.array(*[
        F.struct(
            F.lit(d).alias("direction"), F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(n).alias("distance"),
            F.lit(blank).alias("blank_score"), F.lit(used).alias("used_score"), F.lit(conf).alias("confidence"),
        )
        for d, r, c, n, blank, used, conf in fixed.VALUE_POSITIONS
    ])
    spread = attach(matches, size, ["job_id", "sheet"], "inner").select(
        "job_id", "sheet", "label", "mapping_id", F.col("score").alias("match_score"), F.col("row_idx").alias("label_row"), F.col("col_idx").alias("label_col"),
        F.explode(places).alias("p"), "__rows", "__cols",
    )
    targets = spread.select(
        "job_id", "sheet", "label", "mapping_id", "match_score", "label_row", "label_col", "p.direction", "p.distance", "p.confidence",
        (F.col("label_row") + F.col("p.dr")).alias("row_idx"), (F.col("label_col") + F.col("p.dc")).alias("col_idx"), "p.blank_score", "p.used_score", "__rows", "__cols",
    ).where("row_idx <= __rows + 2 AND col_idx <= __cols + 3")
    seen = targets.join(cells.select("job_id", "sheet", "row_idx", "col_idx", "value_str"), ["job_id", "sheet", "row_idx", "col_idx"], "left")
    free = seen.where(F.col("value_str").isNull() | ~looks_like_label("value_str"))
    return free.withColumn("position_score", F.when(F.col("value_str").isNull(), F.col("blank_score")).otherwise(F.col("used_score"))).drop(
        "blank_score", "used_score", "__rows", "__cols"
    ).withColumnRenamed("value_str", "existing_value")


def label_confidence(match_score: Column, position: Column) -> Column:
    return F.when(position == "low", "low").when(match_score >= 84, "high").when(match_score >= 60, "medium").otherwise("low")


def rank_candidates(positions: DataFrame, rows: DataFrame, keep: int = 3) -> DataFrame:
    """Best place and two alternatives of each result row; rows without a place need manual review.

    The best offer of each cell counts; cells are ranked by score, then by address.
    """
    score = F.round(F.least(F.col("position_score") + F.col("match_score") / 1000, F.lit(0.99)), 3)
    confidence = label_confidence(F.col("match_score"), F.col("confidence"))
    offers = positions.select(
        "job_id", "mapping_id", "sheet", S.a1_encode("row_idx", "col_idx").alias("cell"), score.alias("score"), confidence.alias("confidence"), "label"
    )
    offers = offers.groupBy("job_id", "mapping_id", "sheet", "cell").agg(F.max_by(F.struct("score", "confidence", "label"), "score").alias("b")).select(
        "job_id", "mapping_id", "sheet", "cell", "b.*"
    )
    order = Window.partitionBy("job_id", "mapping_id").orderBy(F.col("score").desc(), "cell", "sheet")
    ranked = offers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    risk = risk_of(F.col("confidence"))
    placed = rows.select("job_id", "mapping_id", "metric").join(ranked, ["job_id", "mapping_id"], "left")
    return placed.select(
        "job_id", "mapping_id", "metric", F.coalesce("rank", F.lit(1)).alias("rank"), "sheet", F.coalesce("cell", F.lit("")).alias("cell"),
        F.when(F.col("rank").isNull(), "manual_review_required").otherwise("matched_label").alias("status"),
        F.coalesce("confidence", F.lit("low")).alias("confidence"), F.coalesce("score", F.lit(0.21)).alias("score"),
        risk.alias("risk_level"), (risk == "high").alias("requires_confirmation"),
    )


def fill_plan_mode(jobs: DataFrame, target_sheets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mode of each job (result_sheet, header_layout, label_value) with its matched and unconfirmed candidates.

    `target_sheets`: job_id, sheet, mode (output of `roles.target_sheet`). Without a target sheet every
    candidate is low (0.18) and unconfirmed.
    """
    counts = candidates.where("rank = 1").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("cell") != "").alias("matched"), F.count_if("requires_confirmation").alias("unconfirmed")
    )
    joined = jobs.select("job_id").distinct().join(target_sheets.select("job_id", "sheet", "mode"), "job_id", "left").join(counts, "job_id", "left")
    lost = F.col("mode").isNull()
    return joined.select(
        "job_id", F.coalesce("mode", F.lit("result_sheet")).alias("mode"), F.coalesce("sheet", F.lit(fixed.RESULT_SHEET_TITLE)).alias("target_sheet"),
        F.when(lost, 0).otherwise(F.coalesce("matched", F.lit(0))).alias("matched"),
        F.when(lost, F.coalesce("all", F.lit(0))).otherwise(F.coalesce("unconfirmed", F.lit(0))).alias("unconfirmed"),
    )
