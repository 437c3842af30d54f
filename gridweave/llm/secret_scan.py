"""Secret scanning of versioned files with a ledger of what has been scanned.

Every version of a file is addressed by its content. A content (blob) is scanned once per version of the
rules, however many paths and versions hold it; findings are joined back to all of them. What the ledger
has already is not scanned again. All steps are DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import whole_text


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and without overlap, whose `group` has at least `least` characters.

    `gate` is a pattern that every text with a match contains; it only saves work.
    """

    kind: str
    pattern: str
    group: int
    least: int
    gate: str


BASE_RULES = (
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, "(?i)(?:pass|secret|token|api)"),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
# A scheme has 32 characters at most: an open end would try every start of a long run up to its end.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY"),
    Rule("forge", "gh[opsur]_[A-Za-z0-9]+", 0, 40, "gh[opsur]_"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 40, "eyJ"),
    Rule("url", "[a-z][a-z0-9+.-]{0,31}://[^\\x20\\x09-\\x0D/:@]+:([^\\x20\\x09-\\x0D/@]+)@", 1, 4, "://"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"


def blob_of(text: str = "text") -> Column:
    """Address of a content."""
    return F.sha2(whole_text(text), 256)


def unseen_blobs(versions: DataFrame, path: str, text: str, rule_version: str, ledger: DataFrame | None) -> DataFrame:
    """blob and text, one row per content that `ledger` (blob, rule_version) does not have for this rule version.

    Versions are read once, and copies of one content, under whatever paths, are united before texts are dealt: a
    task sends each content once at most.
    """
    blobs = versions.select(blob_of(text).alias("blob"), whole_text(text).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs
    return blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of each blob: blob, rank (place of the rule), kind, start, end, value; code points, end exclusive.

    A match begins after the gaps and matches before it: a text is cut at the matches of a rule, and the
    lengths of gaps and matches are added up in the order of the text.
    """

    def cut(place: int, rule: Rule) -> Column:
        text, pattern = F.col("text"), F.lit(rule.pattern)
        gaps = F.split(text, rule.pattern, -1)
        wholes = F.regexp_extract_all(text, pattern, F.lit(0))
        values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else wholes
        parts = F.zip_with(F.arrays_zip(wholes.alias("w"), values.alias("v")), gaps, lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("size"), m["v"].alias("value")))
        return F.when(text.rlike(rule.gate), F.struct(F.lit(place).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), parts.alias("parts")))

    by_rule = blobs.select("blob", F.explode(F.filter(F.array(*[cut(i, r) for i, r in enumerate(rules)]), lambda c: c.isNotNull())).alias("c"))
    parts = by_rule.select("blob", "c.rank", "c.kind", "c.least", F.posexplode("c.parts").alias("at", "part")).where(F.col("part.size").isNotNull())
    through = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ended = parts.withColumn("end", F.sum(F.col("part.gap") + F.col("part.size")).over(through))
    found = ended.where(F.length("part.value") >= F.col("least"))
    return found.select("blob", "rank", "kind", (F.col("end") - F.col("part.size")).alias("start"), "end", F.col("part.value").alias("value")).distinct()


def scan_history(
    versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION,
    ledger: DataFrame | None = None, findings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings of all contents in `versions`, and the ledger entries to append.

    `ledger` has blob and rule_version of what was scanned before, `findings` what came of it (the columns
    of `scan` and rule_version). Only contents without an entry for `rule_version` are scanned. Null text is
    the empty content. Repeated versions cost nothing. An empty table gives empty results. Contents
    without a match of any gate have no findings; they go before texts are dealt.
    """
    suspect = F.lit(False)
    for rule in rules:
        suspect = suspect | F.col(text).rlike(rule.gate)
    new = unseen_blobs(versions.where(suspect), path, text, rule_version, ledger)
    found = scan(new, rules).withColumn("rule_version", F.lit(rule_version))
    if findings is not None:
        held = findings.where(F.col("rule_version") == rule_version).join(versions.select(blob_of(text).alias("blob")).distinct(), "blob", "left_semi")
        found = found.unionByName(held.select(*found.columns))
    seen = versions.select(blob_of(text).alias("blob")).distinct().withColumn("rule_version", F.lit(rule_version))
    if ledger is not None:
        seen = seen.join(ledger.select("blob", "rule_version"), ["blob", "rule_version"], "left_anti")
    return found, seen


def findings_by_path(versions: DataFrame, found: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per version: path, blob, and its findings as an array in the order of start, then rule (empty if none)."""
    entry = F.struct("start", "rank", "kind", "end", "value")
    per_blob = found.groupBy("blob").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    rows = versions.select(F.col(path), blob_of(text).alias("blob"))
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>")
    return rows.join(per_blob, "blob", "left").select(path, "blob", F.coalesce("found", nothing).alias("found"))


def redact_secrets(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each finding in their texts replaced by its kind in brackets; overlapping findings become the first one.

    Only contents with findings are joined; the other texts, and nulls, stay as they are.
    """
    per_blob = found.groupBy(F.col("blob").alias("__blob")).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("__found"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, e: Column) -> Column:
        gap = F.substring(F.col(text), (state["at"] + 1).cast("int"), (e["start"] - state["at"]).cast("int"))
        inside = e["start"] < state["at"]
        return F.struct(F.greatest(state["at"], e["end"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], gap, F.lit("["), e["kind"], F.lit("]"))).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(F.col(text), (state["at"] + 1).cast("int"), F.length(text)))

    met = docs.withColumn("__blob", blob_of(text)).join(per_blob, "__blob", "left")
    return met.withColumn(text, F.when(F.col("__found").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.aggregate("__found", start, step, finish))).select(*docs.columns)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and spans per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob."""
    found, _ = scan_history(docs)
    rows = findings_by_path(docs, found)

    def joined(entries: Column) -> Column:
        return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda e: e["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda e: e["rank"] < len(BASE_RULES))
    return rows.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "blob")
