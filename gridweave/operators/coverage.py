"""Topic coverage, KPIs, gaps and reports per company.

Input is a long `segments` table: company, doc_id, doc_idx, doc_name, seg_idx, segment_id, location, text. Rules
are matched where the segments are read; what is exchanged is one small row per document and rule.
Counts per company are combined on the map side, so one company may hold any share of the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.operators.scaling import number_rows
from gridweave.rules import fixed
from gridweave.rules.sets import RuleSet

DOC_BLOCK = 4096


# --- facts ------------------------------------------------------------------------------------

BEST = "struct<cost: int, value: double, place: int, unit: string>"


def _fact(kind: str, rule: str, pillar: Column | None = None, topic: Column | None = None, best: Column | None = None) -> Column:
    text, none = F.lit(None).cast("string"), F.lit(None).cast(BEST)
    return S.record(kind=F.lit(kind), rule=F.lit(rule), pillar=text if pillar is None else pillar, topic=text if topic is None else topic, best=none if best is None else best.cast(BEST))


def segment_facts(
    segments: DataFrame, rules: RuleSet, kinds: Sequence[str] = ("pillar", "topic", "kpi"), compat: bool = False, compat_first: bool = False, values: bool = True
) -> DataFrame:
    """What the rules find in the segments, as rows of one schema: `kind` is pillar, topic or kpi, `rule` its name.

    Each segment is read once: its text is lowered once, its numbers are cut out once and only where a KPI
    keyword occurs. A row carries the place and the beginning of its segment, never the text. KPI rows have
    pillar, topic, value and unit; where only their number counts, `values=False` leaves value and unit null and
    looks for one number that is no year. `compat` reads numbers without thousands separators; `compat_first` always
    gives a KPI the first topic. Null and empty texts give no rows.
    """
    hit = lambda words: S.contains_any("__low", words)
    found: list[Column] = []
    if "pillar" in kinds:
        found += [F.when(hit(words), _fact("pillar", name)) for name, words in rules.pillar_keywords.items()]
    if "topic" in kinds:
        found += [F.when(hit(t.keywords), _fact("topic", t.topic, topic=F.lit(t.topic))) for t in rules.topics]
    lowered = segments.where("text IS NOT NULL").withColumn("__low", F.lower("text"))
    if "kpi" in kinds and rules.kpis:
        first_topic = F.lit(rules.topics[0].topic if rules.topics else None).cast("string")
        told = [F.when(hit([*t.keywords, *t.kpi_patterns]), F.lit(t.topic)) for t in rules.topics]
        topic = first_topic if compat_first or not told else F.coalesce(*told)
        any_hit = hit([w for k in rules.kpis for w in k.keywords])
        numbers = _kpi_numbers("text", compat) if values else _has_number("text", compat)
        lowered = lowered.withColumns({"__numbers": F.when(any_hit, numbers), "__topic": F.when(any_hit, topic)})
        for i, kpi in enumerate(rules.kpis):
            fits = hit(kpi.keywords)
            for other in rules.kpis[:i]:
                if other.metric == kpi.metric:
                    fits = fits & ~hit(other.keywords)
            best = _best_of(F.col("__numbers"), kpi.preferred_units) if values else None
            found.append(F.when(fits if values else fits & F.col("__numbers"), _fact("kpi", kpi.metric, F.lit(kpi.pillar), F.col("__topic"), best)))
    none = F.lit(None).cast(f"struct<kind: string, rule: string, pillar: string, topic: string, best: {BEST}>")
    long = lowered.select(
        "company", "doc_id", "doc_idx", "doc_name", "seg_idx", "segment_id", "location",
        F.substring("text", 1, max(fixed.KPI_EVIDENCE_CHARS, fixed.TOPIC_SAMPLE_CHARS)).alias("__begin"), F.explode_outer(F.array(*(found or [none]))).alias("fact"),
    ).where("fact IS NOT NULL")
    if values:
        long = long.where("fact.kind <> 'kpi' OR fact.best IS NOT NULL")
    size = F.when(F.col("fact.kind") == "kpi", fixed.KPI_EVIDENCE_CHARS).when(F.col("fact.kind") == "topic", fixed.TOPIC_SAMPLE_CHARS).otherwise(0)
    return long.select(
        "company", "doc_id", "doc_idx", "doc_name", "seg_idx", "segment_id", "location", "fact.kind", "fact.rule", "fact.pillar", "fact.topic",
        F.col("fact.best.value").alias("value"), F.col("fact.best.unit").alias("unit"), F.col("__begin").substr(F.lit(1), size).alias("excerpt"),
    )


PLACE = ("doc_id", "doc_idx", "doc_name", "seg_idx", "location", "excerpt")


def compact_facts(facts: DataFrame) -> DataFrame:
    """Facts for counts and samples, with the number `n` of equal ones: topics keep their place, pillars their document, KPIs neither.

    KPIs are as many as segments; here they are counted on the map side, one row per company, name, pillar and topic.
    """
    is_topic, has_document = F.col("kind") == "topic", F.col("kind").isin("topic", "pillar")
    place = [F.when(has_document if c == "doc_id" else is_topic, F.col(c)).alias(c) for c in PLACE]
    return facts.groupBy("company", "kind", "rule", "pillar", "topic", *place).agg(F.count(F.lit(1)).alias("n"))


def topic_facts(facts: DataFrame) -> DataFrame:
    """Per company and topic: documents and segments with it, KPIs that have it, and its first sample (`facts` may be compact)."""
    is_topic = F.col("kind") == "topic"
    sample = F.struct(F.col("excerpt").alias("sample"), "location", "doc_name", "doc_id")
    told = facts.where(F.col("kind").isin("topic", "kpi") & F.col("topic").isNotNull())
    counted = told if "n" in facts.columns else compact_facts(told)
    number = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))
    sums = counted.groupBy("company", "topic").agg(
        F.count_distinct(F.when(is_topic, F.col("doc_id"))).alias("documents"), number(is_topic).alias("evidence"), number(~is_topic).alias("kpis"),
        F.min_by(sample, F.when(is_topic, F.struct("doc_idx", "seg_idx"))).alias("s"),
    )
    return sums.select(
        "company", "topic", "documents", "evidence", "kpis", F.col("s.sample").alias("sample"), F.col("s.location").alias("sample_location"),
        F.col("s.doc_name").alias("sample_document"), F.col("s.doc_id").alias("sample_doc_id"),
    )


def kpi_facts(facts: DataFrame) -> DataFrame:
    """The KPIs among the facts: metric, pillar, topic, value, unit and their place."""
    return facts.where("kind = 'kpi'").select(
        "company", "doc_id", "doc_idx", "doc_name", "seg_idx", "segment_id", "location", F.col("excerpt").alias("evidence"), "topic", F.col("rule").alias("metric"), "pillar", "value", "unit"
    )


# --- coverage ---------------------------------------------------------------------------------


def companies(documents: DataFrame) -> DataFrame:
    return documents.select("company").distinct()


def pillar_coverage(segments: DataFrame, rules: RuleSet, owners: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Documents and segments per company and pillar; every pillar has a row.

    `owners` (company) spares reading the segments a second time for the list of companies, `facts` reading
    them at all.
    """
    found = (segment_facts(segments, rules, ["pillar"]) if facts is None else facts).where("kind = 'pillar'")
    counted = found if "n" in found.columns else compact_facts(found)
    counts = counted.groupBy("company", F.col("rule").alias("pillar")).agg(F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("evidence"))
    return every_rule(companies(segments if owners is None else owners), "pillar", list(rules.pillars), "pillar_idx").join(counts, ["company", "pillar"], "left").na.fill(0, ["documents", "evidence"]).withColumn(
        "label", S.lookup(rules.pillars, "pillar")
    )


def pillar_documents(segments: DataFrame, rules: RuleSet) -> DataFrame:
    """Names of the documents of each pillar, one row each (a company may have any number)."""
    return segment_facts(segments, rules, ["pillar"]).select("company", F.col("rule").alias("pillar"), "doc_name").distinct()


def every_rule(owners: DataFrame, name: str, names: Sequence[str], index: str) -> DataFrame:
    """All rules for every company, with their order."""
    return owners.select("company", F.posexplode(S.string_array(list(names))).alias(index, name))


def topic_coverage(segments: DataFrame, rules: RuleSet) -> DataFrame:
    """Documents, segments and first sample per company and topic that occurs."""
    return topic_facts(segment_facts(segments, rules, ["topic"])).drop("kpis")


def topic_matrix(segments: DataFrame | None, rules: RuleSet, owners: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Every topic of every company as covered, weak or missing, with the number of its KPIs (`owners`, `facts` as in `pillar_coverage`)."""
    entries = [
        F.create_map(*[x for t in rules.topics for x in (F.lit(t.topic), value(t))])
        for value in (lambda t: F.lit(t.label), lambda t: F.lit(t.pillar), lambda t: F.lit(t.weak_threshold), lambda t: S.string_array(list(t.required_kinds)))
    ]
    label, pillar, threshold, kinds = (F.try_element_at(m, F.col("topic")) for m in entries)
    found = topic_facts(segment_facts(segments, rules, ["topic"]) if facts is None else facts)
    joined = every_rule(companies(segments if owners is None else owners), "topic", [t.topic for t in rules.topics], "rule_idx").join(found, ["company", "topic"], "left")
    status = F.when(F.coalesce("documents", F.lit(0)) == 0, "missing").when(F.col("evidence") < F.col("weak_threshold"), "weak").otherwise("covered")
    return (
        joined.withColumns({"label": label, "pillar": pillar, "weak_threshold": threshold, "required_kinds": kinds})
        .withColumn("status", status).na.fill(0, ["documents", "evidence", "kpis"]).drop("weak_threshold")
    )


def recommended_kinds(matrix: DataFrame) -> DataFrame:
    """Kinds required by the weak and missing topics of each company (kinds come from the rules)."""
    return matrix.where("status <> 'covered'").groupBy("company").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("required_kinds")))).alias("recommended_kinds")
    )


def coverage_stats(matrix: DataFrame) -> DataFrame:
    """Topics by status per company."""
    return matrix.groupBy("company").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in fixed.STATUS_LABELS], F.count(F.lit(1)).alias("total")
    )


def standard_codes(text: str, request: str | None = None) -> Column:
    """Codes of the reporting standards that a whole text or the request names; the first one always applies."""
    always, *others = fixed.STANDARDS
    asked = [code for code, _, _, words in others if any(w in (request or "").lower() for w in words)]
    return F.concat(S.string_array([always[0], *asked]), S.labels_found(f"lower(coalesce({text}, ''))", {code: words for code, _, _, words in others}))


def named_standards(hits: DataFrame) -> DataFrame:
    """Name and priority of each (company, code)."""
    return hits.select(
        "company", "code", S.lookup({c: n for c, n, _, _ in fixed.STANDARDS}, "code").alias("name"),
        S.lookup({c: str(p) for c, _, p, _ in fixed.STANDARDS}, "code").cast("int").alias("priority"),
    )


def standards(documents: DataFrame, request: str | None = None) -> DataFrame:
    """Reporting standards of each company, from its whole texts (or from `text` cut to a preview by the caller) and the request; the first one always applies."""
    return named_standards(documents.select("company", F.explode_outer(standard_codes("text", request)).alias("code")).distinct())


# --- KPIs -------------------------------------------------------------------------------------


def best_number(text: str, preferred: Sequence[str], compat: bool = False) -> Column:
    """The number a KPI takes from a text: preferred unit first, then any unit, then the lowest; years do not count."""
    return _best_of(_kpi_numbers(text, compat), preferred)


def _kpi_numbers(text: str, compat: bool) -> Column:
    return F.filter(S.number_units(text, compat), lambda n: ~n["value"].between(*fixed.YEAR_RANGE))


def _has_number(text: str, compat: bool) -> Column:
    """Whether a text has a number that is no year. Mostly the first one is none; else the least and the greatest tell."""
    low, high = fixed.YEAR_RANGE
    as_number = lambda t: F.replace(t, F.lit(","), F.lit("")).cast("double")
    pattern = F.lit(f"({S.value_pattern(compat)})")
    first = F.regexp_extract(F.col(text), f"({S.value_pattern(compat)})", 1)
    others = F.exists(F.regexp_extract_all(F.col(text), pattern, 1), lambda t: ~as_number(t).between(low, high))
    return F.when(first == "", False).when(~as_number(F.nullif(first, F.lit(""))).between(low, high), True).otherwise(others)


def _best_of(numbers: Column, preferred: Sequence[str]) -> Column:
    units = list(preferred)

    def rank(n: Column, i: Column) -> Column:
        liked = n["unit"].isin(units) if units else F.lit(False)
        cost = -(F.when(liked, 4).otherwise(0) + F.when(n["unit"] != "", 1).otherwise(0))
        return S.record(cost=cost, value=n["value"], place=i, unit=n["unit"])

    return F.array_min(F.transform(numbers, rank))


def extract_kpis(segments: DataFrame, rules: RuleSet, compat: bool = False, compat_first: bool = False) -> DataFrame:
    """KPIs of each segment: metric, value, unit, source, evidence and topic (options as in `segment_facts`)."""
    return kpi_facts(segment_facts(segments, rules, ["kpi"], compat, compat_first))


# --- gaps -------------------------------------------------------------------------------------


def disclosure_matrix(matrix: DataFrame, kpis: DataFrame | None, chosen: DataFrame) -> DataFrame:
    """Topic matrix with KPI status, required data, related standards and the next action.

    `chosen`: output of `standards`; a company has five at most. Without `kpis` the matrix has to come from
    facts that hold KPIs; its own counts decide then.
    """
    codes = chosen.groupBy("company").agg(F.sort_array(F.collect_set("code")).alias("__codes"))
    if kpis is not None:
        with_kpi = kpis.where("topic IS NOT NULL").select("company", "topic").distinct().withColumn("__k", F.lit(1))
        matrix = matrix.join(with_kpi, ["company", "topic"], "left").withColumn("kpis", F.coalesce("__k", F.lit(0))).drop("__k")
    joined = matrix.join(codes, "company", "left")
    label, status = F.col("label"), F.col("status")
    no_kpi = F.col("kpis") == 0
    required = F.array_distinct(F.concat(
        "required_kinds",
        F.when(status == "missing", F.array(F.concat(label, F.lit(fixed.REQUIRED_POLICY)))).otherwise(S.string_array([])),
        F.when(no_kpi, F.array(F.concat(label, F.lit(fixed.REQUIRED_KPI)))).otherwise(S.string_array([])),
    ))
    related = F.array_compact(F.array(*[
        F.when(
            F.array_contains(F.coalesce("__codes", S.string_array([])), code) & (F.lit(True) if pillar is None else F.col("pillar") == pillar), F.lit(code)
        )
        for code, pillar in fixed.RELATED_STANDARDS.items()
    ]))
    says = {state: F.concat(F.lit(before), label, F.lit(after)) for state, (before, after) in fixed.NEXT_ACTION.items()}
    action = (
        F.when(status == "missing", says["missing"]).when(status == "weak", says["weak"])
        .when(F.size("required_data") > 0, says["incomplete"]).otherwise(fixed.NEXT_ACTION_NONE)
    )
    return (
        joined.withColumns({"kpi_status": F.when(no_kpi, "missing").otherwise("available"), "required_data": required, "related_standards": related})
        .withColumn("next_action", action).drop("kpis", "__codes")
    )


def data_requests(items: DataFrame, rules: RuleSet) -> DataFrame:
    """Numbered requests for what is not covered with a KPI: owner, priority, reason. As many as topics at most."""
    open_items = items.where("NOT (status = 'covered' AND kpi_status = 'available')")
    order = Window.partitionBy("company").orderBy("rule_idx")
    owner = F.coalesce(S.lookup(rules.owners, "pillar"), F.lit(fixed.DEFAULT_OWNER)) if rules.owners else F.lit(fixed.DEFAULT_OWNER)
    return open_items.select(
        "company", F.concat(F.lit("req_"), F.row_number().over(order).cast("string")).alias("request_id"), "topic", "label", owner.alias("owner"),
        F.when(F.col("status") == "missing", "high").otherwise("medium").alias("priority"), "required_data", "required_kinds", F.col("next_action").alias("reason"), F.lit("open").alias("status"),
    )


LINK_ORDER = ("o1", "o2", "o3", "o4", "o5")
LINK = ("type", "claim", "disclosure_id", "document", "location", "excerpt", "support_level")


def topic_claims(matrix: DataFrame) -> DataFrame:
    """The topics with a sample as claims: company, order and the columns of a link."""
    return matrix.where("sample_document IS NOT NULL").select(
        "company", F.lit(0).alias("o1"), F.lit("").alias("o2"), F.lit("").alias("o3"), F.col("rule_idx").cast("bigint").alias("o4"), F.lit(0).alias("o5"),
        F.lit("topic").alias("type"), F.concat("label", F.lit("："), S.lookup(fixed.STATUS_LABELS, "status")).alias("claim"), F.col("topic").alias("disclosure_id"),
        F.col("sample_document").alias("document"), F.col("sample_location").alias("location"), F.col("sample").alias("excerpt"),
        F.when(F.col("status") == "covered", "supported").otherwise("weak").alias("support_level"),
    )


def evidence_claims(matrix: DataFrame, kpis: DataFrame) -> DataFrame:
    """All claims of the links: topics first, then KPIs in the order pillar, metric, document."""
    return topic_claims(matrix).unionByName(kpis.select(
        "company", F.lit(1).alias("o1"), F.col("pillar").alias("o2"), F.col("metric").alias("o3"), F.col("doc_idx").cast("bigint").alias("o4"), F.col("seg_idx").alias("o5"),
        F.lit("kpi").alias("type"), F.concat("metric", F.lit("="), S.number_text("value"), "unit").alias("claim"), F.col("topic").alias("disclosure_id"),
        F.col("doc_name").alias("document"), "location", F.col("evidence").alias("excerpt"), F.lit("supported").alias("support_level"),
    ))


def _link(number: Column) -> list[Column]:
    return [F.col("company"), F.concat(F.lit("link_"), number.cast("string")).alias("link_id"), number.alias("link_no"), *map(F.col, LINK)]


def evidence_links(matrix: DataFrame, kpis: DataFrame) -> DataFrame:
    """Numbered claims with their evidence: topics first, then KPIs in the order pillar, metric, document.

    The numbering runs in blocks of (kind, pillar, metric, document block), so a company with very many
    KPIs is numbered in many tasks.
    """
    block = F.struct("o1", "o2", "o3", F.floor(F.col("o4") / DOC_BLOCK).alias("b"))
    return number_rows(evidence_claims(matrix, kpis), ["company"], [F.col(c) for c in LINK_ORDER], block, "n").select(*_link(F.col("n")))


def first_links(matrix: DataFrame, kpis: DataFrame, keep: int) -> DataFrame:
    """The first `keep` links of each company: each task passes on that many per company, the others are not numbered."""
    rank = F.row_number().over(Window.partitionBy("company").orderBy(*LINK_ORDER))
    return evidence_claims(matrix, kpis).withColumn("n", rank).where(F.col("n") <= keep).select(*_link(F.col("n").cast("bigint")))


def material_summary(pillars: DataFrame, matrix: DataFrame, rules: RuleSet) -> DataFrame:
    """One summary text per company: documents per pillar, topics by status, missing pillars."""
    parts = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pillar_idx", F.concat("label", F.lit(" "), F.col("documents").cast("string"), F.lit(fixed.SUMMARY_PILLAR_UNIT)).alias("t")))), lambda x: x["t"]), "；"
    )
    lost = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("documents") == 0, F.struct("pillar_idx", "label")))), lambda x: x["label"]), "、")
    base = pillars.groupBy("company").agg(parts.alias("parts"), lost.alias("lost")).join(coverage_stats(matrix), "company")
    counts = F.concat(*[
        x for s in fixed.STATUS_LABELS for x in (F.lit(f"{'' if s == 'covered' else ' / '}{s} "), F.col(s).cast("string"))
    ])
    tail = F.when(F.col("lost") != "", F.concat(F.lit(fixed.SUMMARY_LOST), "lost", F.lit("。"))).otherwise("")
    return base.select(
        "company", *fixed.STATUS_LABELS, "total", F.concat(F.lit(fixed.SUMMARY_PILLARS), "parts", F.lit(fixed.SUMMARY_TOPICS), counts, F.lit("。"), tail).alias("summary")
    )


def kpi_summary(kpis: DataFrame, owners: DataFrame, keep: int | None = 5) -> DataFrame:
    """One text per company: how many KPIs there are and the first `keep` of them; companies without KPIs say so."""
    counted = kpis.groupBy("company").agg(F.count(F.lit(1)).alias("n_kpis"))
    shown = first_kpis(kpis, keep).groupBy("company").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("metric", F.lit("="), S.number_text("value"), "unit").alias("t")))), lambda x: x["t"]), "；").alias("__said")
    )
    before, between, after = fixed.KPI_SUMMARY
    said = F.concat(F.lit(before), F.col("n_kpis").cast("string"), F.lit(between), "__said", F.lit(after))
    joined = owners.select("company").distinct().join(counted, "company", "left").join(shown, "company", "left")
    return joined.select("company", F.coalesce("n_kpis", F.lit(0)).alias("n_kpis"), F.coalesce(said, F.lit(fixed.KPI_SUMMARY_NONE)).alias("summary"))


EVIDENCE = ("company", "number", "title", "doc_id", "document", "location", "excerpt", "segment_id")


def topic_evidence(matrix: DataFrame, keep: int | None = 5) -> DataFrame:
    """The samples of the first `keep` topics of each company as evidence rows; topics without document or text give none."""
    rows = matrix if keep is None else matrix.where(F.col("rule_idx") < keep)
    excerpt = S.strip("sample")
    told = rows.where((F.coalesce("sample_document", F.lit("")) != "") & (F.coalesce(excerpt, F.lit("")) != ""))
    return told.select(
        "company", F.col("rule_idx").cast("bigint").alias("number"), F.col("label").alias("title"), F.col("sample_doc_id").alias("doc_id"), F.col("sample_document").alias("document"),
        F.coalesce(S.blank_to_null(S.strip("sample_location")), F.lit(fixed.NO_LOCATION)).alias("location"), excerpt.alias("excerpt"), F.lit(None).cast("string").alias("segment_id"),
    )


def kpi_evidence(kpis: DataFrame, keep: int | None = 5) -> DataFrame:
    """The first `keep` KPIs of each company as evidence rows."""
    return first_kpis(kpis, keep).select(
        "company", F.col("n").cast("bigint").alias("number"), F.concat("metric", F.lit("："), S.number_text("value"), "unit").alias("title"), "doc_id",
        F.coalesce(S.blank_to_null("doc_name"), F.lit(fixed.NO_DOCUMENT)).alias("document"), F.coalesce(S.blank_to_null("location"), F.lit(fixed.NO_LOCATION)).alias("location"),
        F.coalesce("evidence", F.lit("")).alias("excerpt"), "segment_id",
    )


def request_stats(requests: DataFrame) -> DataFrame:
    """Data requests by priority per company."""
    return requests.groupBy("company").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("priority") == p).alias(p) for p in ("high", "medium")])


def link_stats(links: DataFrame) -> DataFrame:
    """Evidence links by support and by type per company. Rows with a column `n` stand for so many links."""
    n = F.col("n") if "n" in links.columns else F.lit(1)
    number = lambda of: F.coalesce(F.sum(F.when(of, n)), F.lit(0)).cast("bigint")
    return links.groupBy("company").agg(
        number(F.lit(True)).alias("total"), *[number(F.col("support_level") == s).alias(s) for s in ("supported", "weak")], *[number(F.col("type") == t).alias(f"{t}_links") for t in ("topic", "kpi")]
    )


def counted_links(matrix: DataFrame, facts: DataFrame) -> DataFrame:
    """What `link_stats` needs of the links of compact facts: company, type, support_level and their number."""
    topics = topic_claims(matrix).select("company", "type", "support_level", F.lit(1).cast("bigint").alias("n"))
    return topics.unionByName(facts.where("kind = 'kpi'").select("company", F.lit("kpi").alias("type"), F.lit("supported").alias("support_level"), "n"))


# --- reports ----------------------------------------------------------------------------------


def first_kpis(kpis: DataFrame, keep: int | None = None) -> DataFrame:
    """KPIs of each company numbered in the order pillar, metric, document; the first `keep` of them if a display limit is given."""
    order = Window.partitionBy("company").orderBy("pillar", "metric", "doc_name", "doc_idx", "seg_idx")
    numbered = kpis.withColumn("n", F.row_number().over(order))
    return numbered if keep is None else numbered.where(F.col("n") <= keep)


def _line(section: int, number: Column | int, text: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), (F.lit(number) if isinstance(number, int) else number.cast("int")).alias("number"), text.alias("text"))


def _join_lines(lines: DataFrame) -> DataFrame:
    """Lines (company, l) as one text per company; display limits of the caller bound it."""
    return lines.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["text"]), "\n").alias("markdown"))


def outline(matrix: DataFrame, kpis: DataFrame, rules: RuleSet, keep: int | None = None) -> DataFrame:
    """Report outline per company: sections by pillar with the status of each topic, first KPIs."""
    owners = companies(matrix)
    fixed_lines = [_line(0, i, F.lit(t)) for i, t in enumerate(fixed.OUTLINE_HEAD)]
    section = {p: i + 1 for i, p in enumerate(rules.pillars)}
    for pillar, label in rules.pillars.items():
        fixed_lines.append(_line(section[pillar], -1, F.lit(f"## {label}")))
        if not any(t.pillar == pillar for t in rules.topics):
            fixed_lines.append(_line(section[pillar], 0, F.lit(label.join(fixed.OUTLINE_EMPTY_PILLAR))))
    lines = owners.select("company", F.explode(F.array(*fixed_lines)).alias("l"))
    topic_text = F.concat(F.lit("- "), "label", F.lit("（"), S.lookup(fixed.STATUS_LABELS, "status"), F.lit("）"))
    numbers = F.create_map(*[x for p, n in section.items() for x in (F.lit(p), F.lit(n))])
    topics = matrix.where(F.col("pillar").isin(list(section))).select(
        "company", F.struct(F.element_at(numbers, F.col("pillar")).alias("section"), F.col("rule_idx").cast("int").alias("number"), topic_text.alias("text")).alias("l")
    )
    last = len(section) + 1
    shown = first_kpis(kpis, keep)
    kpi_text = F.concat(F.lit("- "), "metric", F.lit("："), S.number_text("value"), "unit", F.lit(" ("), "doc_name", F.lit(")"))
    kpi_lines = shown.select("company", _line(last, F.col("n"), kpi_text).alias("l"))
    kpi_head = shown.select("company").distinct().select("company", _line(last, 0, F.lit(fixed.OUTLINE_KPIS)).alias("l"))
    return _join_lines(lines.unionByName(topics).unionByName(kpi_head).unionByName(kpi_lines))


def recommendations(pillars: DataFrame, matrix: DataFrame, kpis: DataFrame) -> DataFrame:
    """Recommendations per company, numbered: missing pillars, wanted kinds, no KPIs."""
    lost = pillars.where("documents = 0").groupBy("company").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pillar_idx", "label"))), lambda x: x["label"]), "、").alias("lost")
    )
    joined = (
        companies(matrix).join(lost, "company", "left").join(recommended_kinds(matrix), "company", "left")
        .join(kpis.select("company").distinct().withColumn("__k", F.lit(True)), "company", "left")
    )
    texts = F.array_compact(F.array(
        F.concat(F.lit(fixed.RECOMMEND_PILLARS), "lost"),
        F.when(F.size("recommended_kinds") > 0, F.concat(F.lit(fixed.RECOMMEND_KINDS), F.array_join("recommended_kinds", "、"))),
        F.when(F.col("__k").isNull(), fixed.RECOMMEND_KPIS),
    ))
    return joined.select("company", F.posexplode_outer(texts).alias("number", "recommendation")).where("number IS NOT NULL")


def report_draft(
    items: DataFrame, kpis: DataFrame, links: DataFrame, chosen: DataFrame, rules: RuleSet, request: Column | None = None,
    kpi_rows: int | None = None, topic_rows: int | None = None, gap_rows: int | None = None, link_rows: int | None = None, sample_chars: int | None = None,
) -> DataFrame:
    """Report draft per company: summary, pillars, KPI table, gaps, evidence index and word count.

    `items` is the disclosure matrix, `links` the evidence links, `chosen` the standards. Everything is
    shown unless a display limit is given.
    """
    up_to = lambda df, column, most: df if most is None else df.where(F.col(column) <= most)
    need = S.length_requirement(request if request is not None else F.lit(""))
    is_range = F.rlike(request, F.lit(fixed.LENGTH_RANGE_PATTERN)) if request is not None else F.lit(False)
    words = F.when(is_range, F.concat_ws("-", need["lower"], need["upper"])).otherwise(need["target"].cast("string"))
    length = F.when(need["explicit"], F.concat(F.lit("篇幅要求 "), words, F.lit(" 字。"))).otherwise("")
    codes = chosen.groupBy("company").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "code"))), lambda x: x["code"]), "、").alias("codes")
    )
    shown = first_kpis(kpis, kpi_rows)
    counted = kpis.groupBy("company").agg(F.count(F.lit(1)).alias("kpi_count"), F.count_distinct("metric").alias("metric_count"))
    facts = coverage_stats(items).join(codes, "company", "left").join(counted, "company", "left").na.fill(0, ["kpi_count", "metric_count"])
    number = lambda c: F.col(c).cast("string")
    section = {p: i + 2 for i, p in enumerate(rules.pillars)}
    kpi_section, gap_section, link_section = len(section) + 2, len(section) + 3, len(section) + 4
    has_kpi, heading = F.col("kpi_count") > 0, fixed.REPORT_HEADINGS
    head = [
        _line(0, 0, F.lit(heading["title"])), _line(0, 1, F.lit("")), _line(0, 2, F.lit(heading["about"])),
        _line(0, 3, F.concat(F.lit("草稿由材料汇总得出，标准："), F.coalesce("codes", F.lit("GRI")), F.lit("。"), length)),
        _line(1, 0, F.lit("")), _line(1, 1, F.lit(heading["summary"])),
        _line(1, 2, F.concat(
            F.lit("主题共 "), number("total"), F.lit(" 个：covered "), number("covered"), F.lit("，weak "), number("weak"), F.lit("，missing "), number("missing"),
            F.lit("。指标 "), number("metric_count"), F.lit(" 种，取值 "), number("kpi_count"), F.lit(" 条。"),
        )),
    ]
    for pillar, label in rules.pillars.items():
        head += [_line(section[pillar], -2, F.lit("")), _line(section[pillar], -1, F.lit(f"## {label}"))]
        if not any(t.pillar == pillar for t in rules.topics):
            head.append(_line(section[pillar], 0, F.lit("（规则中没有此支柱的主题）")))
    head += [
        _line(kpi_section, -4, F.lit("")), _line(kpi_section, -3, F.lit(heading["kpis"])),
        _line(kpi_section, -2, F.when(has_kpi, fixed.REPORT_KPI_HEADER).otherwise("（无）")),
        F.when(has_kpi, _line(kpi_section, -1, F.lit("| --- | ---: | --- | --- |"))),
        _line(gap_section, -2, F.lit("")), _line(gap_section, -1, F.lit(heading["gaps"])),
        F.when(F.col("weak") + F.col("missing") == 0, _line(gap_section, 0, F.lit("（无）"))),
        _line(link_section, -2, F.lit("")), _line(link_section, -1, F.lit(heading["evidence"])),
    ]
    lines = facts.select("company", F.explode_outer(F.array_compact(F.array(*head))).alias("l"))

    rank = F.row_number().over(Window.partitionBy("company", "pillar").orderBy("rule_idx"))
    numbers = F.create_map(*[x for p, n in section.items() for x in (F.lit(p), F.lit(n))])
    sample = S.strip(F.coalesce("sample", F.lit("")))
    quote = sample if sample_chars is None else F.substring(sample, 1, sample_chars)
    state = S.lookup(fixed.STATUS_LABELS, "status")
    body = F.concat_ws("\n", F.concat(F.lit("状态："), state), F.when(quote != "", F.concat(F.lit("> "), quote)), F.when(F.col("status") != "covered", F.col("next_action")))
    ranked = up_to(items.where(F.col("pillar").isin(list(section))).withColumn("n", rank), "n", topic_rows)
    topics = ranked.select(
        "company", F.struct(
            F.element_at(numbers, F.col("pillar")).alias("section"), F.col("n").cast("int").alias("number"), F.concat(F.lit("### "), "label", F.lit("\n"), body).alias("text")
        ).alias("l")
    )
    row = F.concat(
        F.lit("| "), F.concat_ws(" | ", "metric", S.number_text("value"), F.when(F.col("unit") == "", "-").otherwise(F.col("unit")), F.concat("doc_name", F.lit(" / "), "location")), F.lit(" |")
    )
    table_rows = shown.select("company", _line(kpi_section, F.col("n"), row).alias("l"))
    gap_rank = F.row_number().over(Window.partitionBy("company").orderBy("rule_idx"))
    gaps = up_to(items.where("status <> 'covered'").withColumn("n", gap_rank), "n", gap_rows).select(
        "company", _line(gap_section, F.col("n"), F.concat(F.lit("- "), "label", F.lit("："), "next_action")).alias("l")
    )
    index = up_to(links, "link_no", link_rows).select(
        "company", _line(link_section, F.col("link_no"), F.concat(F.lit("- "), "claim", F.lit("："), "document", F.lit(" / "), "location")).alias("l")
    )
    no_links = companies(items).join(links.select("company").distinct(), "company", "left_anti").select("company", _line(link_section, 0, F.lit("（无）")).alias("l"))
    text = _join_lines(lines.unionByName(topics).unionByName(table_rows).unionByName(gaps).unionByName(index).unionByName(no_links))
    return text.select("company", S.strip("markdown").alias("report"), S.word_count("markdown").alias("words"))
