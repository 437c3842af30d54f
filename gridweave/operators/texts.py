"""Documents: segments, pages, ranking for a request, summaries, kinds, previews and evidence.

A document is one row. Its segments are an array inside that row until the very end, so segmentation,
scoring and the choice of the best segments need no shuffle and no window: only numbers per document
are exchanged.

Arrays that are computed are unnested with the outer generators: the plain ones make the optimizer add a
filter on the size of the array, which computes the array a second and a third time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.functions import segmentation as G
from gridweave.operators.scaling import attach
from gridweave.rules import fixed


# --- segments ---------------------------------------------------------------------------------


def with_segments(documents: DataFrame, text: str = "text", kind: str = "paragraph", limit: int = fixed.SEGMENT_CHARS) -> DataFrame:
    """Adds `segments`, the array of segment texts of each document."""
    return documents.withColumn("segments", G.segment_texts(F.col(text), limit))


def explode_segments(
    documents: DataFrame, keys: Sequence[str], kind: str = "paragraph", label_prefix: str = "正文片段", page: str | None = None
) -> DataFrame:
    """Segments in long form with number, id, label and location."""
    long = documents.select(*keys, *([page] if page and page not in keys else []), F.posexplode_outer("segments").alias("seg_idx", "text")).where("seg_idx IS NOT NULL")
    number = (F.col("seg_idx") + 1).cast("string")
    if page is None:
        segment_id, label, place = F.concat(F.lit(kind + "_"), number), F.concat(F.lit(label_prefix + " "), number), None
    else:
        at = F.col(page).cast("string")
        segment_id = F.concat(F.lit(kind + "_"), at, F.lit("_"), number)
        label, place = F.concat(F.lit("第 "), at, F.lit(" 页 "), number), F.col(page)
    named = long.select("*", segment_id.alias("segment_id"), label.alias("label"))
    return named.withColumn("location", S.location_text(page=place, label=F.col("label")))


def normalized_text(content: Column, second: Column, summary: Column) -> Column:
    """Text of a document: content and second version merged, or the one there is, or the structural summary."""
    a, b = S.strip(F.coalesce(content, F.lit(""))), S.strip(F.coalesce(second, F.lit("")))
    return (
        F.when((a != "") & (b != ""), S.merge_text(a, b, None)).when(b != "", b).when(a != "", a)
        .otherwise(S.strip(F.coalesce(summary, F.lit(""))))
    )


def segment_kind(content: Column, second: Column, summary: Column) -> Column:
    a, b, c = (S.strip(F.coalesce(x, F.lit(""))) for x in (content, second, summary))
    return F.when(a != "", "paragraph").when(b != "", "ocr").when(c != "", "summary")


def line_sections(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines with the section they belong to: a short line without sentence marks opens a section.

    The lines are cut at the headings: each slice from one heading to the next has one section, so the work
    grows with the number of lines. Null and empty texts have no lines.
    """
    marks = "".join(fixed.HEADING_PUNCTUATION)

    def is_heading(line: Column) -> Column:
        return (F.length(line) <= fixed.HEADING_MAX_CHARS) & (F.length(F.translate(line, marks, "")) == F.length(line))

    cut = documents.select(key, S.text_lines(F.col(text)).alias("__lines"))
    places = F.filter(F.transform("__lines", lambda line, i: F.when(is_heading(line), i)), lambda i: i.isNotNull())
    placed = cut.withColumn("__heads", places)
    n = F.size("__lines")

    def stretch(at: Column, k: Column) -> Column:
        until = F.coalesce(F.get("__heads", k + 1), n)
        return F.array_repeat(F.get("__lines", at), until - at)

    before = F.array_repeat(F.lit(None).cast("string"), F.coalesce(F.get("__heads", F.lit(0)), n))
    folded = placed.select(key, "__lines", F.concat(before, F.flatten(F.transform("__heads", stretch))).alias("__sections"))
    pairs = F.arrays_zip(F.col("__lines").alias("line"), F.col("__sections").alias("section"))
    return folded.select(key, F.posexplode_outer(pairs).alias("line_idx", "p")).where("line_idx IS NOT NULL").select(key, "line_idx", "p.line", "p.section")


# --- pages ------------------------------------------------------------------------------------


def merge_pages(native: DataFrame, second: DataFrame, keys: Sequence[str], label: str = "OCR 补全") -> DataFrame:
    """Two versions of the pages of documents as one; pages without any text are dropped."""
    a = native.select(*keys, F.col("text").alias("__a"))
    b = second.select(*keys, F.col("text").alias("__b"))
    return a.join(b, list(keys), "full_outer").select(*keys, S.merge_text("__a", "__b", label).alias("text")).where("text <> ''")


def needs_second_pass(pages: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Documents to read again: no text, fewer pages with text than pages, or few characters per page.

    `expected`: key, page_count.
    """
    size = F.length("text")
    stats = pages.where(size > 0).groupBy(key).agg(F.count(F.lit(1)).alias("pages_with_text"), F.sum(size).alias("chars"))
    joined = expected.join(stats, key, "left").na.fill(0, ["pages_with_text", "chars"])
    average = F.when(F.col("pages_with_text") > 0, F.col("chars") / F.col("pages_with_text"))
    return joined.withColumn(
        "again", F.col("pages_with_text").eqNullSafe(0) | (F.col("pages_with_text") < F.col("page_count")) | (average < fixed.MIN_PAGE_CHARS)
    )


# --- ranking ----------------------------------------------------------------------------------


def score_documents(documents: DataFrame, keywords: Column) -> DataFrame:
    """Score of every segment and of the whole document for a list of keywords.

    `documents` needs `segments` (array of texts), `doc_name`, `doc_type`, `kinds` (array). Scores are
    counted in hundredths: 180 less 8 per position but 10 at least, 400 plus up to two occurrences per
    keyword in the segment, 100 per keyword in the document's name, type or kinds. A column `places`, if there is one, tells
    where the segments come from: array<struct<section, sheet, page, row_start>> in their order, nulls allowed. Section and
    sheet are searched with the text; a page adds 20, a sheet 40, a row 30. Result columns:
    `scored` array<struct<points, seg_idx, matched, text>> of the segments that count, best first,
    `matched` (keywords of the document), `points` (best segment).
    """
    about = F.lower(F.concat_ws(" ", "doc_name", "doc_type", F.array_join("kinds", " ")))

    placed = "places" in documents.columns

    def score(text: Column, i: Column) -> Column:
        label = F.concat(F.lit("正文片段 "), (i + 1).cast("string"))
        bonus = F.lit(0)
        if placed:
            at = F.try_element_at("places", i + 1)
            named = [F.when(at[c] != "", at[c]) for c in ("section", "sheet")]
            place = F.lower(F.concat_ws(" ", label, *named, text))
            for there, points in ((at["page"].isNotNull(), 20), (named[1].isNotNull(), 40), (at["row_start"].isNotNull(), 30)):
                bonus = bonus + F.when(there, points).otherwise(0)
        else:
            place = F.lower(F.concat(label, F.lit(" "), text))

        def body(lowered: Column) -> Column:
            found = F.filter("__keywords", lambda k: F.contains(lowered, k))
            inside = F.aggregate(
                found, F.lit(0), lambda acc, k: acc + 400 + 100 * F.least(S.occurrences(lowered, k), F.lit(2))
            )
            outside = F.size(F.filter("__keywords", lambda k: ~F.contains(lowered, k) & F.contains(F.col("__about"), k))) * 100
            base = F.greatest(F.lit(10), 180 - i * 8)
            return S.record(points=base + inside + outside + bonus, seg_idx=i, matched=found, text=text)

        return S.let(place, body)

    def best_first(every: Column) -> Column:
        matching = F.filter(every, lambda s: F.size(s["matched"]) > 0)
        keyed = S.let(
            matching, lambda hits: F.transform(F.when(F.size(hits) > 0, hits).otherwise(every), lambda s: S.record(o=-s["points"], i=s["seg_idx"], s=s))
        )
        return F.transform(F.array_sort(keyed), lambda x: x["s"])

    # One expression from the segments to the sorted list, so that nothing is computed twice.
    prepared = documents.select("*", keywords.alias("__keywords"), about.alias("__about"))
    return (
        prepared.withColumn("scored", S.let(F.transform("segments", score), best_first))
        .withColumn("matched", F.array_distinct(F.flatten(F.transform("scored", lambda s: s["matched"]))))
        .withColumn("points", F.coalesce(F.try_element_at("scored", F.lit(1))["points"], F.lit(0)))
        .drop("__keywords", "__about")
    )


def relevant_documents(scored: DataFrame, request: Sequence[str], spread: str = "doc_idx") -> DataFrame:
    """If any document of a request matched a keyword, only those that did."""
    facts = scored.groupBy(*request).agg(F.bool_or(F.size("matched") > 0).alias("__any"))
    return attach(scored, facts, request, "inner").where((F.size("matched") > 0) | ~F.col("__any")).drop("__any")


def top_documents(scored: DataFrame, request: Sequence[str], max_documents: int) -> DataFrame:
    """The best documents of each request in order (`doc_rank` from 1): most keywords, best score, first.

    Ranks are compared on numbers only; the group limit below the shuffle keeps `max_documents` rows per
    request and task. That no keyword-less document ranks above one with keywords is part of the order,
    and whether to drop the others is known from the best rank.
    """
    hits = F.size("matched")
    order = Window.partitionBy(*request).orderBy(hits.desc(), F.col("points").desc(), "doc_idx")
    ranked = scored.withColumn("doc_rank", F.row_number().over(order)).where(F.col("doc_rank") <= max_documents)
    best = F.max(hits).over(Window.partitionBy(*request))
    return ranked.withColumn("__best", best).where((hits > 0) | (F.col("__best") == 0)).drop("__best")


def spend_budget(top: DataFrame, request: Sequence[str], per_document: int, total: int) -> DataFrame:
    """Segments chosen from the ranked documents: some per document, all within one budget spent in rank order."""
    wanted = F.least(F.size("scored"), F.lit(per_document))
    before = Window.partitionBy(*request).orderBy("doc_rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(wanted).over(before), F.lit(0))
    return top.withColumn("taken", F.least(wanted, F.greatest(F.lit(total) - spent, F.lit(0))).cast("int")).where("taken > 0").withColumn(
        "selected", F.expr("slice(scored, 1, taken)")
    )


def extractive_summary(selected: DataFrame, request: Sequence[str], per_document: int = 2, chars: int = 260, segment_chars: int = fixed.EXCERPT_CHARS) -> DataFrame:
    """Numbered lines with the best segments of the best documents, as one text per request."""
    excerpt = S.strip(F.array_join(F.transform(F.slice("selected", 1, per_document), lambda s: S.cut(S.strip(s["text"]), segment_chars)), " "))
    line = F.concat(F.col("doc_rank").cast("string"), F.lit(". "), "doc_name", F.lit("："), F.substring(excerpt, 1, chars))
    return selected.groupBy(*request).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("summary")
    )


def excerpt_draft(selected: DataFrame, request: Sequence[str], task: str, per_document: int = 3, chars: int = 900, segment_chars: int = 320) -> DataFrame:
    """A Markdown draft with the best segments of the best documents under their labels."""
    def block(s: Column) -> Column:
        heading = F.concat(F.lit("### 正文片段 "), (s["seg_idx"] + 1).cast("string"), F.lit("\n"))
        return F.concat(heading, S.cut(S.strip(s["text"]), segment_chars))

    body = F.array_join(F.transform(F.slice("selected", 1, per_document), block), "\n\n")
    part = F.concat(F.lit("## "), "doc_name", F.lit("\n"), F.substring(body, 1, chars))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_rank", part.alias("p")))), lambda x: x["p"]), "\n\n")
    return selected.groupBy(*request).agg(
        F.concat(F.lit("# 修订稿\n\n任务："), F.first(task), F.lit("\n\n## 整理内容\n\n"), parts).alias("draft")
    )


# --- kinds, previews, evidence ----------------------------------------------------------------


def infer_kinds(name: str, doc_type: str, text: str, tags: str | None = None, kinds: dict[str, list[str]] | None = None) -> Column:
    """Kinds of a document by keywords in name, type, tags and text; general if there are none."""
    parts = [name, doc_type, *([f"array_join({tags}, ' ')"] if tags else []), text]
    return S.labels_found(F.lower(F.concat_ws(" ", *[F.expr(p) for p in parts])), kinds or fixed.DOCUMENT_KINDS, fixed.DEFAULT_KIND)


def document_counts(documents: DataFrame) -> DataFrame:
    """Documents by type and by each of their kinds, in one pass."""
    tags = F.concat(
        F.array(F.struct(F.lit("type").alias("dimension"), F.col("doc_type").alias("name"))),
        F.transform("kinds", lambda k: F.struct(F.lit("kind").alias("dimension"), k.alias("name"))),
    )
    return documents.select(F.explode_outer(tags).alias("t")).groupBy("t.dimension", "t.name").agg(F.count(F.lit(1)).alias("documents"))


def completeness(documents: DataFrame, required: DataFrame, case: str) -> DataFrame:
    """Readiness of each case: required kinds, kinds there are, kinds that are missing, unreadable documents.

    `required`: case, kind. Kinds come from a fixed list, so the arrays per case are short.
    """
    present = documents.withColumn("k", F.explode_outer("kinds")).groupBy(case).agg(F.sort_array(F.collect_set("k")).alias("present"))
    facts = documents.groupBy(case).agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("readable")).alias("unreadable"))
    wanted = required.groupBy(case).agg(F.sort_array(F.collect_set("kind")).alias("required"))
    joined = wanted.join(present, case, "left").join(facts, case, "left").na.fill(0, ["documents", "unreadable"])
    missing = F.array_except("required", F.coalesce("present", S.string_array([])))
    return joined.withColumn("missing", missing).withColumn(
        "readiness",
        F.when((F.size("missing") > 0) & (F.col("documents") == 0), "missing").when((F.size("missing") > 0) | (F.col("unreadable") > 0), "partial").otherwise("ready"),
    )


def document_preview(documents: DataFrame, key: str) -> DataFrame:
    """Name, type, preview, number of segments and kinds of each document."""
    return documents.select(
        key, "doc_name", "doc_type", S.clip("text", fixed.PREVIEW_CHARS).alias("preview"), F.size("segments").alias("segment_count"), F.array_join("kinds", ",").alias("kinds")
    )


def document_evidence(documents: DataFrame, key: str) -> DataFrame:
    """One evidence row per document: its first segment, or a preview of its text."""
    first = F.try_element_at("segments", F.lit(1))
    return documents.select(
        key, F.col("doc_name").alias("title"), F.col("doc_name").alias("document"),
        F.when(first.isNotNull(), S.location_text(label=F.lit("正文片段 1"))).otherwise("正文摘要").alias("location"),
        S.clip(F.coalesce(first, F.col("text"))).alias("excerpt"), F.when(first.isNotNull(), "paragraph_1").alias("segment_id"),
    )


EVIDENCE_PLACES = ["segment_id", "page", "sheet", "row_start", "row_end", "cell_range", "section"]


def merge_evidence(evidence: DataFrame, report: Sequence[str], keep: int = 8) -> DataFrame:
    """Best evidence of each report: complete, without repeats, most precise place first, then shortest, then title."""
    present = [c for c in EVIDENCE_PLACES if c in evidence.columns]
    places = F.lit(0)
    for c in present:
        places = places + (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")
    # Completeness is judged by the aggregate: a filter would be pushed below the dealing of the texts and cut every
    # excerpt there once more, in the few tasks that read the file.
    complete = F.expr("coalesce(title, '') <> '' AND coalesce(document, '') <> '' AND coalesce(excerpt, '') <> ''")
    key = [*report, "title", "document", "location", "excerpt", *(["segment_id"] if "segment_id" in present else [])]
    single = evidence.groupBy(*key).agg(F.max(F.when(complete, places)).alias("places")).where("places IS NOT NULL")
    order = Window.partitionBy(*report).orderBy(F.col("places").desc(), F.length("excerpt"), "title", "document", "location", "excerpt")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
