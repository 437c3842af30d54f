"""Filling target tables from source tables or result rows, with an audit row for every attempt.

The write rule is one ladder of conditions over (value, existing value, policy, merged cell). "First
value wins" is an aggregation per target cell, so many source rows for one target cost a combine on
the map side and not a sequential scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators.scaling import attach, number_rows, row_block, running_total
from gridweave.rules import fixed

STATUSES = {
    "written": "written", "kept_existing": "kept_existing", "preserved_existing": "preserved_existing",
    "source_empty": "source_empty", "invalid_manual_mapping": "invalid_manual", "requires_confirmation": "requires_confirmation",
    "manual_mapping_skipped": "skipped_manual", "blocked_merged_cell": "blocked_merged", "blocked_by_crosscheck": "blocked_review",
}


# --- matching headers -------------------------------------------------------------------------


def header_score(source: Column, target: Column) -> Column:
    """1.0 for equal tokens, 0.72 if one of two tokens of two characters or more holds the other."""
    inside = (F.length(source) >= 2) & (F.length(target) >= 2) & (F.contains(source, target) | F.contains(target, source))
    return F.when((source == "") | (target == ""), 0.0).when(source == target, 1.0).when(inside, 0.72).otherwise(0.0)


def match_headers(pairs: DataFrame) -> DataFrame:
    """One-to-one header mapping per pair of sheets (columns source_headers, target_headers as arrays).

    Target headers pick in order; each takes the best source header that is left, by score, then by
    name. The pick is a fold over the two short lists inside the row of the pair.
    """
    sources = F.transform(
        F.filter("source_headers", lambda h: S.strip(h) != ""), lambda h: F.struct(h.alias("name"), S.norm_token(h).alias("token"))
    )
    targets = F.transform(
        "target_headers", lambda h, i: F.struct(S.strip(h).alias("name"), S.norm_token(h).alias("token"), (i + 1).alias("column"))
    )
    start = F.expr(
        "struct(cast(array() as array<string>) AS used, cast(array() as array<struct<source_header:string,target_header:string,target_col:int,score:double>>) AS picks)"
    )

    def pick(acc: Column, target: Column) -> Column:
        def option(source: Column) -> Column:
            return F.struct((-header_score(source["token"], target["token"])).alias("cost"), source["name"].alias("name"))

        free = F.filter("__sources", lambda s: ~F.array_contains(acc["used"], s["name"]) & (header_score(s["token"], target["token"]) > 0))
        best = F.array_min(F.transform(free, option))
        row = F.struct(
            best["name"].alias("source_header"), target["name"].alias("target_header"), target["column"].alias("target_col"),
            (-best["cost"]).alias("score"),
        )
        return F.when(F.size(free) == 0, acc).otherwise(
            F.struct(F.array_append(acc["used"], best["name"]).alias("used"), F.array_append(acc["picks"], row).alias("picks"))
        )

    keys = [c for c in pairs.columns if c not in ("source_headers", "target_headers")]
    prepared = pairs.select(*keys, sources.alias("__sources"), targets.alias("__targets"))
    picked = prepared.select(*keys, F.explode_outer(F.aggregate("__targets", start, pick)["picks"]).alias("m")).where("m IS NOT NULL")
    return picked.select(*keys, "m.*")


def key_priority(header: Column | str) -> Column:
    """How much a header looks like a key: 0 (id, code) to 7, NULL if not at all."""
    token = S.norm_token_sql(header) if isinstance(header, str) else None
    ladder = None
    for step, words in enumerate([*fixed.KEY_HEADERS_EXACT, *fixed.KEY_HEADERS_CONTAINED]):
        exact = step < len(fixed.KEY_HEADERS_EXACT)
        if token is not None:
            hit = S.in_words(token, words) if exact else S.contains_any(token, words)
        else:
            hit = S.norm_token(header).isin(words) if exact else S.contains_any(S.norm_token(header), words)
        ladder = F.when(hit, step) if ladder is None else ladder.when(hit, step)
    return ladder


def choose_key(mappings: DataFrame, pair_keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """The key mapping of each pair: both headers look like keys, lowest sum of priorities, then target header."""
    ranked = mappings.withColumn("priority", key_priority("source_header") + key_priority("target_header")).where("priority IS NOT NULL")
    return ranked.groupBy(*pair_keys).agg(
        F.min_by(F.struct("source_header", "target_header", "target_col", "priority"), F.struct("priority", "target_header")).alias("k")
    ).select(*pair_keys, "k.*")


def transfer_mode(pairs: DataFrame, mappings: DataFrame, keys: DataFrame, matched: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Mode per pair: result_sheet without a mapping, keyed_blank_fill with matched keys that can be filled, else header_mapping.

    `matched`: pair_id of pairs with a fillable matched cell. `blocks`: pair_id of pairs a review blocks;
    such a pair writes nothing and gets one audit row.
    """
    flagged = (
        pairs.select("pair_id").join(mappings.select("pair_id").distinct().withColumn("__m", F.lit(True)), "pair_id", "left")
        .join(keys.select("pair_id").distinct().join(matched.select("pair_id").distinct(), "pair_id").withColumn("__k", F.lit(True)), "pair_id", "left")
    )
    mode = F.when(F.col("__m").isNull(), "result_sheet").when(F.col("__k"), "keyed_blank_fill").otherwise("header_mapping")
    if blocks is None:
        return flagged.select("pair_id", mode.alias("mode"), F.lit(None).cast("string").alias("status"))
    stopped = flagged.join(blocks.select("pair_id").distinct().withColumn("__b", F.lit(True)), "pair_id", "left")
    return stopped.select("pair_id", mode.alias("mode"), F.when(F.col("__b"), "blocked_by_crosscheck").alias("status"))


# --- the write rule ---------------------------------------------------------------------------


def write_policy(name: Column) -> Column:
    """Known policy, else only_empty."""
    policy = S.strip(name)
    return F.when(policy.isin(fixed.WRITE_POLICIES), policy).otherwise("only_empty")


def write_status(value: Column, existing: Column, policy: Column | None = None, blocked: Column | None = None) -> Column:
    """What happens to one cell: blocked, source_empty, written, kept_existing or preserved_existing.

    only_empty and allow_same act alike; force_overwrite writes whatever is there.
    """
    ladder = F.when(blocked, "blocked_merged_cell") if blocked is not None else F.when(F.lit(False), "")
    ladder = ladder.when(value.isNull() | (value == ""), "source_empty")
    if policy is not None:
        ladder = ladder.when(policy == "force_overwrite", "written")
    return (
        ladder.when(S.is_empty_like(existing), "written")
        .when(S.loose_equal(existing, value), "kept_existing")
        .otherwise("preserved_existing")
    )


def in_merged_range(
    targets: DataFrame, merged: DataFrame, keys: Sequence[str] = ("doc_id", "sheet"), spread: Sequence[str] = ("row_idx", "col_idx"), block: int = 64
) -> DataFrame:
    """Adds `blocked`: the target cell lies in a merged range and is not its first cell.

    Ranges are listed under every block of rows they touch. As merged ranges do not overlap, a block has
    only as many as fit into its rows; they come to the targets of the block as one array.
    """
    touched = F.explode_outer(F.sequence(F.floor(F.col("min_row") / block), F.floor(F.col("max_row") / block)))
    ranges = merged.select(*keys, touched.alias("__block"), F.struct("min_row", "max_row", "min_col", "max_col").alias("r")).groupBy(*keys, "__block").agg(
        F.sort_array(F.collect_list("r")).alias("__ranges")
    )
    placed = targets.withColumn("__block", F.floor(F.col("row_idx") / block))
    inside = "filter(__ranges, r -> row_idx BETWEEN r.min_row AND r.max_row AND col_idx BETWEEN r.min_col AND r.max_col)"
    joined = attach(placed, ranges, [*keys, "__block"]).withColumn("__hit", F.expr(f"try_element_at({inside}, 1)"))
    blocked = F.expr("__hit IS NOT NULL AND NOT (row_idx = __hit.min_row AND col_idx = __hit.min_col)")
    return joined.select(*targets.columns, F.coalesce(blocked, F.lit(False)).alias("blocked"))


# --- keyed fill -------------------------------------------------------------------------------


class KeyedFill:
    """Fill blank cells of a target table from a source table by a key, for one pair of schemas.

    `columns` lists (source column, target column, header score); `source_row` and `target_row` name the
    order columns. Keys are compared as tokens, empty keys never match, and of several target rows with
    one key the first takes all. Hot keys: the target has one row per key after an aggregation, the
    AQE splits the source rows of a hot key.
    """

    def __init__(
        self, source: DataFrame, target: DataFrame, key: tuple[str, str], columns: Sequence[tuple[str, str, float]],
        source_row: str, target_row: str,
    ) -> None:
        self.columns, self.source_row, self.target_row = list(columns), source_row, target_row
        self.target, self.target_key = target, key[1]
        token = S.norm_token_sql(f"cast({key[0]} as string)")
        self.attempts = source.select(
            F.expr(token).alias("__key"), F.col(source_row).alias("source_row"),
            *[F.expr(f"nullif(cast({s} as string), '')").alias(f"__v{i}") for i, (s, _, _) in enumerate(self.columns)],
        ).where("__key <> ''")
        existing = [F.col(t).cast("string").alias(f"__x{i}") for i, (_, t, _) in enumerate(self.columns)]
        rows = target.select(
            F.expr(S.norm_token_sql(f"cast({key[1]} as string)")).alias("__key"), F.col(target_row).alias("target_row"), *existing
        ).where("__key <> ''")
        whole = F.struct("target_row", *[f"__x{i}" for i in range(len(self.columns))])
        first_rows = rows.groupBy("__key").agg(F.min_by(whole, "target_row").alias("t")).select("__key", "t.*")
        per_key = []
        for i in range(len(self.columns)):
            value = F.col(f"__v{i}")
            placed = F.struct("source_row", value.alias("value"))
            real = ~S.is_empty_like(f"__v{i}")
            per_key += [
                F.min(F.when(real, placed)).alias(f"__first{i}"),
                F.max(F.when(value.isNotNull(), placed)).alias(f"__last{i}"),
            ]
        self.matched = first_rows.join(self.attempts.groupBy("__key").agg(*per_key), "__key")

    def fillable(self) -> DataFrame:
        """Columns with at least one blank target cell for a source value: one row of flags as rows."""
        flags = self.matched.agg(
            *[F.bool_or(F.col(f"__last{i}").isNotNull() & S.is_empty_like(f"__x{i}")).alias(f"f{i}") for i in range(len(self.columns))]
        )
        listed = F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"f{i}").alias("ok")) for i in range(len(self.columns))])
        return flags.select(F.explode(listed).alias("f")).where("f.ok").select(F.col("f.m").alias("m"))

    def audit(self, first_column: int = 1) -> DataFrame:
        """One row per source row with a matched key and fillable column: cell, status, value, existing value, risk."""
        joined = attach(self.attempts, self.matched, ["__key"], "inner")
        entries = []
        for i, (source, target, score) in enumerate(self.columns):
            value, before, first = F.col(f"__v{i}"), F.col(f"__x{i}"), F.col(f"__first{i}")
            open_cell = S.is_empty_like(f"__x{i}")
            in_time = first.isNull() | (F.col("source_row") <= first["source_row"])
            status = (
                F.when(value.isNull(), "source_empty")
                .when(open_cell & in_time, "written")
                .when(S.loose_equal(F.when(open_cell, first["value"]).otherwise(before), value), "kept_existing")
                .otherwise("preserved_existing")
            )
            entries.append(
                F.struct(
                    F.lit(i).alias("m"), F.lit(source).alias("source_col"), F.lit(target).alias("target_col"),
                    status.alias("status"), value.alias("value"),
                    F.when(open_cell & ~in_time, first["value"]).otherwise(before).alias("existing_value"),
                    F.lit(float(score)).alias("score"), F.lit("low" if score >= 1.0 else "medium").alias("risk_level"),
                )
            )
        rows = joined.select("source_row", "target_row", F.explode(F.array(*entries)).alias("a")).select("source_row", "target_row", "a.*")
        # The flag table has at most one row per mapped column.
        return rows.join(F.broadcast(self.fillable()), "m").drop("m")

    def filled(self) -> DataFrame:
        """The target table after the fill: blank cells of first key rows take the first real source value."""
        new = self.matched.select("target_row", *[
            F.when(S.is_empty_like(f"__x{i}"), F.coalesce(F.col(f"__first{i}.value"), F.col(f"__last{i}.value"))).alias(f"__n{i}")
            for i in range(len(self.columns))
        ])
        joined = self.target.join(new, F.col(self.target_row) == F.col("target_row"), "left")
        replaced = {
            t: F.coalesce(F.col(f"__n{i}").cast(self.target.schema[t].dataType), F.col(t)).alias(t) for i, (_, t, _) in enumerate(self.columns)
        }
        return joined.select(*[replaced.get(c, F.col(c)) for c in self.target.columns])


# --- append -----------------------------------------------------------------------------------


def append_rows(
    source: DataFrame, target: DataFrame, pair: Sequence[str], columns: Sequence[tuple[str, str, float]], source_row: str, target_row: str
) -> DataFrame:
    """Place source rows into blank target rows in order, the rest below the last row; one audit row per cell.

    The n-th source row of a pair goes to its n-th target row whose mapped cells are all blank. A source
    row without any value uses up a row as well. Both sides are numbered block by block.
    """
    blank = F.expr("true")
    for _, name, _ in columns:
        blank = blank & S.is_empty_like(f"cast({name} as string)")
    shown = [F.col(t).cast("string").alias(f"__x{i}") for i, (_, t, _) in enumerate(columns)]
    free = number_rows(
        target.where(blank).select(*pair, F.col(target_row).alias("target_row"), *shown), pair, [F.col("target_row")], row_block("target_row"), "__n"
    )
    facts = target.groupBy(*pair).agg(F.max(target_row).alias("__last"), F.count_if(blank).alias("__free"))
    values = [F.expr(f"nullif(cast({s} as string), '')").alias(f"__v{i}") for i, (s, _, _) in enumerate(columns)]
    wanted = number_rows(
        source.select(*pair, F.col(source_row).alias("source_row"), *values), pair, [F.col("source_row")], row_block("source_row"), "__n"
    )
    placed = attach(wanted.join(free, [*pair, "__n"], "left"), facts, pair, "inner").withColumn(
        "target_row", F.coalesce("target_row", F.col("__last") + F.col("__n") - F.col("__free"))
    )
    cells = F.array(*[
        F.struct(
            F.lit(i + 1).alias("col_idx"), F.lit(s).alias("source_col"), F.lit(t).alias("target_col"),
            F.when(F.col(f"__v{i}").isNull(), "source_empty").otherwise("written").alias("status"),
            F.col(f"__v{i}").alias("value"), F.col(f"__x{i}").alias("existing_value"),
        )
        for i, (s, t, _) in enumerate(columns)
    ])
    return placed.select(*pair, "source_row", "target_row", F.explode(cells).alias("c")).select(*pair, "source_row", "target_row", "c.*").withColumn(
        "cell", S.a1_encode("target_row", "col_idx")
    )


# --- metric rows of a template with metric and result columns ---------------------------------


def match_metric_rows(rows: DataFrame, template_rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Target row of each result row: the row of its metric if the metric occurs once, else a new row at the end.

    `rows`: job_id, map_idx, metric. `template_rows`: job_id, row_idx, metric (the last of equal ones
    counts). `sheets`: job_id, sheet, max_row, header_row, result_col.
    """
    known = template_rows.where("metric IS NOT NULL AND metric <> ''").groupBy("job_id", "metric").agg(F.max("row_idx").alias("metric_row"))
    once = rows.groupBy("job_id", "metric").agg(F.count(F.lit(1)).alias("times")).where("times = 1")
    reusable = known.join(once, ["job_id", "metric"]).select("job_id", "metric", "metric_row")
    found = attach(rows, reusable, ["job_id", "metric"]).withColumn("__new", F.col("metric_row").isNull())
    numbered = running_total(found, ["job_id"], [F.col("map_idx")], row_block("map_idx"), F.col("__new").cast("int"), "__added")
    placed = attach(numbered, sheets, ["job_id"], "inner")
    last = F.greatest(F.col("max_row"), F.col("header_row"))
    target = F.coalesce("metric_row", last + F.col("__added"))
    return placed.withColumn("target_row", target).select(
        *rows.columns, "sheet", "target_row", S.a1_encode("target_row", "result_col").alias("cell"),
        F.when(F.col("__new"), "append_row").otherwise("matched_existing_metric").alias("status"),
        F.when(F.col("__new"), "medium").otherwise("high").alias("confidence"),
        F.when(F.col("__new"), 0.71).otherwise(0.94).alias("score"),
        F.when(F.col("__new"), "medium").otherwise("low").alias("risk_level"),
        F.when(~F.col("__new"), S.a1_encode(F.greatest(last + F.col("__added") + 1, F.col("target_row") + 1), F.col("result_col"))).alias("alternative_cell"),
    )


# --- candidates: review, overrides, application -----------------------------------------------


def risk_of(confidence: Column) -> Column:
    return F.when(confidence == "high", "low").when(confidence == "medium", "medium").otherwise("high")


def merge_reviews(candidates: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("job_id", "mapping_id")) -> DataFrame:
    """Put reviewer verdicts into the candidates: high or not approved flags, medium lifts low, the issue becomes a reason.

    `verdicts`: keys, approved, risk_level, issue, suggested_sheet, suggested_cell; one row per key.
    """
    review = verdicts.select(
        *keys, F.coalesce("approved", F.lit(True)).alias("review_approved"), S.risk_level(F.col("risk_level")).alias("review_risk_level"),
        S.strip(F.coalesce("issue", F.lit(""))).alias("review_issue"), S.strip("suggested_sheet").alias("review_suggested_sheet"),
        F.upper(S.strip("suggested_cell")).alias("review_suggested_cell"),
    )
    joined = candidates.join(review, list(keys), "left")
    seen = F.col("review_approved").isNotNull()
    flagged = seen & ((F.col("review_risk_level") == "high") | ~F.col("review_approved"))
    lifted = seen & (F.col("review_risk_level") == "medium") & (F.col("risk_level") == "low")
    noted = F.coalesce(F.col("review_issue") != "", F.lit(False))
    reason = F.concat(F.lit(fixed.REVIEW_REASON_PREFIX), "review_issue")
    return joined.withColumns({
        "status": F.when(flagged, "review_flagged").otherwise(F.col("status")),
        "confidence": F.when(flagged, "low").otherwise(F.col("confidence")),
        "risk_level": F.when(flagged, "high").when(lifted, "medium").otherwise(F.col("risk_level")),
        "requires_confirmation": flagged | F.col("requires_confirmation"),
        "reasons": F.when(noted, F.array_append("reasons", reason)).otherwise(F.col("reasons")),
    })


def unconfirmed(candidates: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("job_id", "mapping_id")) -> DataFrame:
    """Candidates that need confirmation and have no override."""
    return candidates.where("requires_confirmation").join(overrides.select(*keys).distinct(), list(keys), "left_anti")


def apply_overrides(candidates: DataFrame, overrides: DataFrame, sheets: DataFrame, keys: Sequence[str] = ("job_id", "mapping_id")) -> DataFrame:
    """Decision per candidate: skipped, manual target, or automatic.

    `candidates` has `options`, an array of (sheet, cell, score, risk_level, requires_confirmation) with the
    top candidate first. `overrides`: keys, enabled, sheet, cell, write_policy, candidate_index. `sheets`
    (job_id, sheet) lists the sheets there are. An override with an invalid target goes back to automatic.
    """
    given = overrides.select(
        *keys, F.coalesce("enabled", F.lit(True)).alias("__on"), F.nullif(S.strip("sheet"), F.lit("")).alias("__sheet"),
        F.nullif(F.upper(S.strip("cell")), F.lit("")).alias("__cell"), write_policy(F.col("write_policy")).alias("__policy"),
        F.coalesce("candidate_index", F.lit(0)).alias("__index"),
    )
    index = F.least(F.greatest(F.coalesce("__index", F.lit(0)), F.lit(0)), F.size("options") - 1) + 1
    chosen = candidates.join(given, list(keys), "left").withColumn("option", F.element_at("options", index.cast("int")))
    targeted = chosen.withColumns({
        "target_sheet": F.coalesce("__sheet", "option.sheet"), "target_cell": F.coalesce("__cell", F.upper("option.cell")),
    })
    real = sheets.select("job_id", F.col("sheet").alias("target_sheet")).distinct().withColumn("__real", F.lit(True))
    checked = attach(targeted, real, ["job_id", "target_sheet"])
    valid = F.coalesce("__real", F.lit(False)) & S.is_a1("target_cell")
    touched = F.col("__on").isNotNull()
    decision = (
        F.when(touched & ~F.col("__on"), "manual_mapping_skipped").when(touched & valid, "manual")
        .when(touched, "invalid_manual_mapping").otherwise("auto")
    )
    top = F.element_at("options", 1)
    manual = F.col("decision") == "manual"
    return checked.withColumns({"decision": decision, "target_valid": valid, "overridden": touched}).withColumns({
        "write_policy": F.when(manual, F.col("__policy")).otherwise("only_empty"),
        "target_sheet": F.when(manual | (F.col("decision") == "auto"), F.col("target_sheet")).otherwise(top["sheet"]),
        "target_cell": F.when(manual | (F.col("decision") == "auto"), F.col("target_cell")).otherwise(F.upper(top["cell"])),
    }).drop("__on", "__sheet", "__cell", "__policy", "__index", "__real", "option")


def gate_candidates(decisions: DataFrame) -> DataFrame:
    """What happens to each decision: write, requires_confirmation, auto_mapping_unresolved, held_back or skipped.

    One unconfirmed candidate of a job holds back all its automatic writes. Manual targets are written
    in any case.
    """
    # `overridden` tells the same as `decision` here and spares the lookup of sheets in the facts.
    waits = F.col("requires_confirmation") & ~F.col("overridden")
    jobs = decisions.groupBy("job_id").agg(F.bool_or(waits).alias("__pending"))
    known = attach(decisions, jobs, ["job_id"], "inner")
    action = (
        F.when(F.col("decision") == "manual_mapping_skipped", "skipped").when(F.col("decision") == "manual", "write")
        .when(waits, "requires_confirmation").when(F.col("__pending"), "held_back")
        .when(F.col("requires_confirmation"), "requires_confirmation")
        .when(F.coalesce("target_valid", F.lit(False)) | ((F.col("decision") == "invalid_manual_mapping") & S.is_a1("target_cell")), "write")
        .otherwise("auto_mapping_unresolved")
    )
    return known.withColumn("action", action).drop("__pending")


def write_candidates(actions: DataFrame, cells: DataFrame, merged: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Audit of the writes: the result cell of every action `write`, and the side columns of its row.

    `cells`: job_id, sheet, row_idx, col_idx, value_str. `merged`: job_id, sheet, min_row .. max_col.
    `layouts`: job_id, sheet, field, col_idx for the known headers; a written result also fills the
    document, sheet, group and metric columns of its row. Of several values for one cell the first real
    one counts, in map_idx order.
    """
    side_values = F.map_from_arrays(
        S.string_array(SIDE_FIELDS), F.array(*[F.col(f).cast("string") if f in actions.columns else F.lit(None).cast("string") for f in SIDE_FIELDS])
    )
    writes = actions.where("action = 'write'").select(
        "job_id", "mapping_id", "map_idx", F.col("target_sheet").alias("sheet"), S.a1_row("target_cell").cast("bigint").alias("row_idx"),
        S.a1_column("target_cell").alias("col_idx"), "write_policy", "decision", F.lit("result").alias("field"), F.col("value").cast("string").alias("value"), side_values.alias("__row"),
    )
    if layouts is not None:
        # The known headers of a sheet are few, so they travel as one array per sheet.
        known = layouts.groupBy("job_id", "sheet").agg(F.collect_list(F.struct("field", F.col("col_idx").cast("int").alias("col_idx"))).alias("__side"))
        sided = attach(writes, known, ["job_id", "sheet"])
        own = F.array(F.struct(F.col("field").alias("field"), F.col("col_idx").alias("col_idx"), F.col("value").alias("value")))
        others = F.expr(
            "transform(filter(coalesce(__side, array()), s -> s.col_idx <> col_idx AND s.field <> 'result'), s -> struct(s.field AS field, s.col_idx AS col_idx, try_element_at(__row, s.field) AS value))"
        )
        spread_out = sided.select("job_id", "mapping_id", "map_idx", "sheet", "row_idx", "write_policy", "decision", F.explode_outer(F.concat(own, others)).alias("w"))
        writes = spread_out.select("job_id", "mapping_id", "map_idx", "sheet", "row_idx", F.col("w.col_idx").alias("col_idx"), "write_policy", "decision", "w.field", "w.value")
    else:
        writes = writes.drop("__row")
    target = ["job_id", "sheet", "row_idx", "col_idx"]
    first = writes.where(~S.is_empty_like("value")).groupBy(*target).agg(F.min_by(F.struct("map_idx", "value"), "map_idx").alias("__first"))
    grid = cells.select(*target[:2], F.col("row_idx").cast("bigint").alias("row_idx"), "col_idx", F.col("value_str").alias("__before"))
    known = attach(attach(writes, first, target), grid, target)
    guarded = in_merged_range(known, merged, ["job_id", "sheet"], ["mapping_id", "field"])
    later = S.is_empty_like("__before") & (F.col("__first.map_idx") < F.col("map_idx"))
    existing = F.when(later, F.col("__first.value")).otherwise(F.col("__before"))
    return guarded.withColumn("existing_value", existing).select(
        "job_id", "mapping_id", "map_idx", "sheet", "row_idx", "col_idx", S.a1_encode("row_idx", "col_idx").alias("cell"), "field",
        write_status(F.col("value"), F.col("existing_value"), F.col("write_policy"), F.col("blocked")).alias("status"),
        "value", "existing_value", "write_policy", F.when(F.col("decision") == "manual", "manual").otherwise("auto").alias("decision_source"),
    )


SIDE_FIELDS = ["doc_name", "sheet_name", "group_col", "group_value", "column", "metric"]


def finish_jobs(audit: DataFrame, jobs: DataFrame) -> DataFrame:
    """Audit rows of jobs in which something was applied; a job without any gets one result_sheet_created row.

    `jobs`: job_id of all jobs. Applied means written, kept_existing or preserved_existing.
    """
    applied = audit.where(F.col("status").isin("written", "kept_existing", "preserved_existing")).select("job_id").distinct()
    kept = audit.join(applied, "job_id", "left_semi").select("job_id", "mapping_id", "sheet", "cell", "status", "value")
    empty = jobs.select("job_id").distinct().join(applied, "job_id", "left_anti")
    created = empty.select(
        "job_id", F.lit(None).cast("string").alias("mapping_id"), F.lit(fixed.RESULT_SHEET_TITLE).alias("sheet"), F.lit(None).cast("string").alias("cell"),
        F.lit("result_sheet_created").alias("status"), F.lit(None).cast("string").alias("value"),
    )
    return kept.unionByName(created)


def block_gate(jobs: DataFrame, reply: str, block_on_high: bool = True) -> DataFrame:
    """Reviewer reply of each job as verdict columns, with the audit status of a blocked job."""
    judged = jobs.withColumn("__v", S.verdict(reply, block_on_high))
    return judged.select(
        *jobs.columns, F.col("__v.status").alias("review_status"), "__v.approved", "__v.risk_level", "__v.block",
        F.when(F.col("__v.block"), "blocked_by_crosscheck").alias("audit_status"), F.array_join("__v.issues", "；").alias("reason"),
    )


# --- audit: statistics, union, validation, report ---------------------------------------------


def audit_stats(audit: DataFrame, keys: Sequence[str], row: str | None = None) -> DataFrame:
    """Audit rows by status; with `row` also the number of different target rows written."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in STATUSES.items()]
    if row is not None:
        counts.append(F.count_distinct(F.when(F.col("status") == "written", F.col(row))).alias("rows_transferred"))
    if "decision_source" in audit.columns:
        for source in ("manual", "auto"):
            counts.append(F.count_if((F.col("status") == "written") & (F.col("decision_source") == source)).alias(f"written_{source}"))
    return audit.groupBy(*keys).agg(*counts)


def audit_union(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Manual and automatic audit as one, and the mode of each job: both names joined by "+" if they differ."""
    union = first.withColumn("__o", F.lit(0)).unionByName(second.withColumn("__o", F.lit(1)))
    modes = union.groupBy(*keys, "mode").agg(F.min("__o").alias("__o")).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "mode"))), lambda m: m["mode"]), "+").alias("mode"),
    )
    return union.drop("__o"), modes


def validate_fill(audit: DataFrame, cells: DataFrame, target: Sequence[str], field: str = "result") -> DataFrame:
    """Re-read the cells of written and kept audit rows and compare; a missing cell fails."""
    checked = audit.where((F.col("field") == field) & F.col("status").isin("written", "kept_existing"))
    found = cells.select(*target, F.col("value_str").alias("actual"), F.lit(True).alias("__there"))
    joined = checked.join(found, list(target), "left")
    passed = F.coalesce("__there", F.lit(False)) & S.validation_equal("actual", "value")
    return joined.withColumn("passed", passed).drop("__there")


def fill_report(audit: DataFrame, rows: DataFrame) -> DataFrame:
    """Report rows of each job: its audit rows, or the rows of a created result sheet, or unlocated rows.

    `rows` are the result rows (job_id, map_idx, metric, value, doc_name, sheet, column) with `result_col`, the
    column of the result in the result sheet.
    """
    plain = audit.where("status <> 'result_sheet_created'").select(
        "job_id", "mapping_id", "status", F.col("sheet").alias("target_sheet"), F.col("cell").alias("target_cell"), "metric", F.col("value").cast("string").alias("value"),
    )
    made = F.coalesce(F.col("status") == "result_sheet_created", F.lit(False))
    jobs = audit.groupBy("job_id").agg(F.max(made).alias("__made"), F.max(F.when(made, F.col("sheet"))).alias("__sheet"))
    # Rows of jobs that are told by their audit alone go before the others are numbered: a job stays whole.
    open_rows = attach(rows, jobs, ["job_id"]).where(F.coalesce("__made", F.lit(True)))
    numbered = number_rows(open_rows, ["job_id"], [F.col("map_idx")], row_block("map_idx"), "__n")
    listed = F.col("__made").isNotNull()
    untold = numbered.select(
        "job_id", F.when(listed, "").otherwise(F.concat(F.lit("row_"), F.col("__n").cast("string"))).alias("mapping_id"),
        F.when(listed, "result_sheet_written").otherwise("not_written").alias("status"),
        F.when(listed, F.col("__sheet")).otherwise("").alias("target_sheet"),
        F.when(listed, S.a1_encode("__n + 1", "result_col")).otherwise("").alias("target_cell"), "metric", F.col("value").cast("string").alias("value"),
    )
    return plain.unionByName(untold)
