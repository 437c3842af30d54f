"""Text queries over documents and conversations. The source of a document is its company."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.functions import segmentation as G
from gridweave.operators import texts as T
from gridweave.plans import sql as Q
from gridweave.plans.catalog import Catalog, table
from gridweave.rules import fixed

# Keyword tables whose words occur in the test documents.
DEMO_KINDS = {"licensed": ["license", "apache"], "contact": ["@"], "prose": ["the", "ing"]}
REQUEST = "please find the license, apache and src1/docs"
KEYWORDS = ["find", "the", "license", "apache", "and", "src1/docs"]


def documents(spark, folder):
    """Documents with name, type, kinds and segments."""
    df = table(spark, folder, "documents", "doc_id").select(
        "doc_id", F.col("doc_id").alias("doc_idx"), F.col("source").alias("company"), "lang", "text", F.concat("lang", F.lit("_"), "doc_id", F.lit(".txt")).alias("doc_name"),
        F.lit("text").alias("doc_type"),
    )
    return T.with_segments(df.withColumn("kinds", T.infer_kinds("doc_name", "doc_type", "text", kinds=DEMO_KINDS)))


def marked(spark, folder):
    """Documents with full stops as exclamation marks, so that sentences can be cut."""
    return table(spark, folder, "documents", "doc_id").select("doc_id", F.translate("text", ".", "!").alias("text"))


MARKED = "(SELECT doc_id, replace(text, '.', '!') AS text FROM documents)"
KIND_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN {Q.contains_any('hay', ws)} THEN '{n}' END" for n, ws in DEMO_KINDS.items()
) + "], lambda k: k IS NOT NULL)"
DOCS = f"""docs AS (SELECT doc_id, source AS company, text, lang || '_' || doc_id || '.txt' AS doc_name, lower(lang || '_' || doc_id || '.txt text ' || text) AS hay FROM documents),
  kinds AS (SELECT *, CASE WHEN len({KIND_LIST}) = 0 THEN ['general'] ELSE {KIND_LIST} END AS kinds FROM docs)"""
SEGMENTS = Q.segments("documents", "doc_id", "text")
KEYS = "[" + ", ".join(Q.quote(k) for k in KEYWORDS) + "]"
SCORES = f"""
  hay AS (SELECT s.doc_id, company, doc_name, seg_idx, s.text, lower('正文片段 ' || (seg_idx + 1) || ' ' || s.text) AS h, lower(doc_name || ' text ' || array_to_string(kinds, ' ')) AS about FROM segments s JOIN kinds USING (doc_id)),
  seg_scores AS (SELECT *, list_filter({KEYS}, lambda k: contains(h, k)) AS matched, CAST(greatest(10, 180 - seg_idx * 8) AS INTEGER)
     + {' + '.join(f"CASE WHEN contains(h, {Q.quote(k)}) THEN 400 + 100 * least({Q.occurrences('h', Q.quote(k))}, 2) WHEN contains(about, {Q.quote(k)}) THEN 100 ELSE 0 END" for k in KEYWORDS)} AS points FROM hay),
  doc_any AS (SELECT doc_id, bool_or(len(matched) > 0) AS hit FROM seg_scores GROUP BY doc_id),
  kept AS (SELECT s.* FROM seg_scores s JOIN doc_any USING (doc_id) WHERE NOT hit OR len(matched) > 0),
  doc_words AS (SELECT doc_id, count(DISTINCT k) AS hits FROM (SELECT doc_id, unnest(matched) AS k FROM kept) GROUP BY doc_id),
  doc_scores AS (SELECT d.doc_id, d.company, d.doc_name, coalesce(w.hits, 0) AS hits, coalesce(max(points), 0) AS points, count(k.doc_id) AS segs FROM kinds d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN doc_words w ON w.doc_id = d.doc_id GROUP BY ALL),
  comp AS (SELECT company, max(hits) AS best FROM doc_scores GROUP BY company),
  ranked AS (SELECT d.*, row_number() OVER (PARTITION BY company ORDER BY hits DESC, points DESC, doc_id) AS doc_rank FROM doc_scores d)"""


def scored(spark, folder):
    return T.score_documents(documents(spark, folder), G.request_keywords(F.lit(REQUEST)))


# Places of segments: four to a page in English documents, rows in the others, a sheet for every third, a section for every fifth.
SECTION = "CASE WHEN seg_idx % 5 = 0 THEN 'License ' || company END"
SHEET = "CASE WHEN seg_idx % 3 = 0 THEN lang WHEN seg_idx % 3 = 1 THEN '' END"
PLACED_SCORES = (
    SCORES.replace("' ' || s.text)", f"coalesce(' ' || {SECTION}, '') || coalesce(' ' || nullif({SHEET}, ''), '') || ' ' || s.text)")
    .replace("seg_idx, s.text, lower(", "seg_idx, s.text, lang, lower(")
    .replace("AS INTEGER)\n     +", f"AS INTEGER) + CASE WHEN lang = 'en' THEN 20 ELSE 30 END + CASE WHEN nullif({SHEET}, '') IS NOT NULL THEN 40 ELSE 0 END\n     +")
)


def placed(spark, folder):
    """Documents whose segments have places."""
    docs = documents(spark, folder)
    english = F.col("lang") == "en"

    def place(text, i):
        return S.record(
            section=F.when(i % 5 == 0, F.concat(F.lit("License "), "company")), sheet=F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, ""),
            page=F.when(english, F.floor(i / 4) + 1), row_start=F.when(~english | F.col("lang").isNull(), i * 10),
        )

    return docs.withColumn("places", F.transform("segments", place))


def budget_sql(documents_kept: int, per_document: int, total: int) -> str:
    return f"""
      top AS (SELECT r.* FROM ranked r JOIN comp USING (company) WHERE doc_rank <= {documents_kept} AND (hits > 0 OR best = 0)),
      want AS (SELECT *, least(segs, {per_document}) AS w FROM top),
      spent AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY company ORDER BY doc_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM want),
      taken AS (SELECT *, CAST(least(w, greatest({total} - before, 0)) AS INTEGER) AS taken FROM spent),
      order_segs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, seg_idx) AS sr FROM kept),
      chosen AS (SELECT t.company, t.doc_rank, t.doc_id, t.doc_name, o.seg_idx, o.text, o.points, sr FROM taken t JOIN order_segs o ON o.doc_id = t.doc_id AND sr <= taken)"""


def register(catalog: Catalog) -> None:
    @catalog.add(
        f"""WITH s AS (SELECT doc_id, {Q.strip('text')} AS t FROM {MARKED}), b AS (SELECT doc_id, unnest({Q.split_blocks('t')}) AS b, generate_subscripts({Q.split_blocks('t')}, 1) AS i FROM s)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS block, b AS text FROM b"""
    )
    def split_blocks(spark, folder):
        """Blocks of each document."""
        return marked(spark, folder).select("doc_id", F.posexplode_outer(G.split_blocks(F.col("text"))).alias("block", "text")).where("block IS NOT NULL")

    @catalog.add(f"WITH {Q.segments(MARKED, 'doc_id', 'text', 300)} SELECT doc_id, seg_idx, text FROM segments")
    def chunk_blocks(spark, folder):
        """Documents with sentence marks as chunks of at most 300 characters."""
        return marked(spark, folder).select("doc_id", F.posexplode_outer(G.segment_texts(F.col("text"), 300)).alias("seg_idx", "text")).where("seg_idx IS NOT NULL")

    @catalog.add(f"WITH s AS (SELECT doc_id, {Q.strip('text')} AS t FROM documents), o AS (SELECT doc_id, {Q.slices('t', 900, 120)} AS a FROM s) SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS slice, unnest(a) AS text FROM o")
    def overlap_slices(spark, folder):
        """Whole texts as overlapping windows."""
        text = S.strip("text")
        return table(spark, folder, "documents", "doc_id").select("doc_id", F.posexplode_outer(G.overlap_slices(text)).alias("slice", "text")).where("slice IS NOT NULL")

    @catalog.add(
        f"WITH {SEGMENTS} SELECT doc_id, seg_idx, text, 'paragraph_' || (seg_idx + 1) AS segment_id, '正文片段 ' || (seg_idx + 1) AS label, '正文片段 ' || (seg_idx + 1) AS location FROM segments"
    )
    def segments(spark, folder):
        """Segments of each document with id, label and location."""
        return T.explode_segments(documents(spark, folder), ["doc_id"])

    @catalog.add(
        f"""WITH {Q.segments("(SELECT conv_id * 100 + turn AS page_key, text FROM conversations)", 'page_key', 'text')}
        SELECT page_key // 100 AS conv_id, page_key % 100 AS turn, seg_idx, text, 'page_' || (page_key % 100) || '_' || (seg_idx + 1) AS segment_id,
               '第 ' || (page_key % 100) || ' 页 ' || (seg_idx + 1) AS label, '第 ' || (page_key % 100) || ' 页 / 第 ' || (page_key % 100) || ' 页 ' || (seg_idx + 1) AS location FROM segments"""
    )
    def page_segments(spark, folder):
        """Segments inside each page (a turn of a conversation is a page)."""
        pages = T.with_segments(table(spark, folder, "conversations", "conv_id"))
        return T.explode_segments(pages, ["conv_id", "turn"], kind="page", page="turn")

    @catalog.add(
        f"""WITH o AS (SELECT conv_id, turn, text FROM conversations), a AS (SELECT * FROM o WHERE turn % 3 <> 0), b AS (SELECT conv_id, turn, text || chr(10) || 'more' AS text FROM o WHERE turn % 3 <> 1)
        SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN a.text IS NULL THEN {Q.strip('b.text')} WHEN b.text IS NULL THEN {Q.strip('a.text')} ELSE {Q.strip('b.text')} END AS text
        FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE {Q.strip("coalesce(a.text, b.text)")} <> ''"""
    )
    def page_merge(spark, folder):
        """Two versions of the pages of a conversation, each with gaps, as one."""
        talk = table(spark, folder, "conversations", "conv_id").select("conv_id", "turn", "text")
        second = talk.where("turn % 3 <> 1").withColumn("text", F.concat("text", F.lit("\nmore")))
        return T.merge_pages(talk.where("turn % 3 <> 0"), second, ["conv_id", "turn"])

    @catalog.add(
        """WITH c AS (SELECT conv_id, max(turn) + 1 AS page_count FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, count(*) AS pages_with_text, sum(length(text)) AS chars FROM conversations
             WHERE role <> 'system' AND length(text) > 0 GROUP BY conv_id)
        SELECT conv_id, page_count, coalesce(pages_with_text, 0) AS pages_with_text, CAST(coalesce(chars, 0) AS BIGINT) AS chars,
               coalesce(pages_with_text, 0) = 0 OR coalesce(pages_with_text, 0) < page_count OR chars / pages_with_text < 120 AS again FROM c LEFT JOIN p USING (conv_id)"""
    )
    def sparse_docs(spark, folder):
        """Conversations to read again: pages without text or too little text."""
        talk = table(spark, folder, "conversations", "conv_id")
        expected = talk.groupBy("conv_id").agg((F.max("turn") + 1).alias("page_count"))
        return T.needs_second_pass(talk.where("role <> 'system'").select("conv_id", "text"), expected, "conv_id")

    @catalog.add(
        f"""WITH l AS (SELECT doc_id, unnest({Q.lines('text')}) AS line, generate_subscripts({Q.lines('text')}, 1) AS i FROM documents),
        h AS (SELECT *, CASE WHEN length(line) <= 28 AND length(translate(line, '。.!?；;：:', '')) = length(line) THEN line END AS head FROM l)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_idx, line, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h"""
    )
    def section_ffill(spark, folder):
        """Lines of each document with the section they belong to."""
        return T.line_sections(table(spark, folder, "documents", "doc_id"), "doc_id")

    @catalog.add(f"WITH {DOCS}, {SEGMENTS}, {SCORES} SELECT doc_id, seg_idx, points, array_to_string(matched, ',') AS matched FROM kept")
    def segment_score(spark, folder):
        """Score and matched keywords of the segments that count for a request."""
        long = scored(spark, folder).select("doc_id", F.explode_outer("scored").alias("s")).where("s IS NOT NULL")
        return long.select("doc_id", "s.seg_idx", "s.points", F.array_join("s.matched", ",").alias("matched"))

    @catalog.add(
        f"WITH {DOCS.replace('AS company, text,', 'AS company, lang, text,')}, {SEGMENTS}, {PLACED_SCORES} SELECT doc_id, seg_idx, points, array_to_string(matched, ',') AS matched FROM kept"
    )
    def segment_score_places(spark, folder):
        """The same for segments with sections, sheets, pages and rows, which are searched and add to the score."""
        scores = T.score_documents(placed(spark, folder), G.request_keywords(F.lit(REQUEST)))
        long = scores.select("doc_id", F.explode_outer("scored").alias("s")).where("s IS NOT NULL")
        return long.select("doc_id", "s.seg_idx", "s.points", F.array_join("s.matched", ",").alias("matched"))

    @catalog.add(f"WITH {DOCS}, {SEGMENTS}, {SCORES} SELECT doc_id, company, hits, points, segs AS segments_kept FROM doc_scores")
    def doc_rank(spark, folder):
        """Rank keys of every document for a request: keywords matched, best score."""
        return scored(spark, folder).select(
            "doc_id", "company", F.size("matched").cast("bigint").alias("hits"), "points", F.size("scored").cast("bigint").alias("segments_kept")
        )

    @catalog.add(f"WITH {DOCS}, {SEGMENTS}, {SCORES} SELECT d.doc_id, d.company, hits FROM doc_scores d JOIN comp USING (company) WHERE hits > 0 OR best = 0")
    def relevant_docs(spark, folder):
        """Documents with a keyword, or all documents of companies that have none."""
        return T.relevant_documents(scored(spark, folder), ["company"]).select("doc_id", "company", F.size("matched").cast("bigint").alias("hits"))

    @catalog.add(f"WITH {DOCS}, {SEGMENTS}, {SCORES}, {budget_sql(6, 2, 10)} SELECT company, doc_rank, doc_id, seg_idx, points, sr AS seg_rank FROM chosen")
    def budget_select(spark, folder):
        """Segments chosen per company: six documents, two segments each, ten in all."""
        chosen = T.spend_budget(T.top_documents(scored(spark, folder), ["company"], 6), ["company"], 2, 10)
        return chosen.select("company", "doc_rank", "doc_id", F.posexplode_outer("selected").alias("p", "s")).where("s IS NOT NULL").select(
            "company", "doc_rank", "doc_id", "s.seg_idx", "s.points", (F.col("p") + 1).alias("seg_rank")
        )

    cut220 = Q.cut(Q.strip("text"), 220)

    @catalog.add(
        f"""WITH {DOCS}, {SEGMENTS}, {SCORES}, {budget_sql(6, 2, 10)},
        e AS (SELECT company, doc_rank, doc_name, {Q.strip(f"string_agg({cut220}, ' ' ORDER BY sr)")} AS x FROM chosen GROUP BY ALL)
        SELECT company, string_agg(doc_rank || '. ' || doc_name || '：' || substr(x, 1, 260), chr(10) ORDER BY doc_rank) AS summary FROM e GROUP BY company"""
    )
    def extract_summary(spark, folder):
        """Summary of the best segments per company."""
        chosen = T.spend_budget(T.top_documents(scored(spark, folder), ["company"], 6), ["company"], 2, 10)
        return T.extractive_summary(chosen, ["company"])

    cut320 = Q.cut(Q.strip("text"), 320)

    @catalog.add(
        f"""WITH {DOCS}, {SEGMENTS}, {SCORES}, {budget_sql(3, 3, 12)},
        e AS (SELECT company, doc_rank, doc_name, string_agg('### 正文片段 ' || (seg_idx + 1) || chr(10) || {cut320}, chr(10) || chr(10) ORDER BY sr) AS x FROM chosen GROUP BY ALL)
        SELECT company, '# 修订稿' || chr(10) || chr(10) || '任务：{REQUEST}' || chr(10) || chr(10) || '## 整理内容' || chr(10) || chr(10) ||
               string_agg('## ' || doc_name || chr(10) || substr(x, 1, 900), chr(10) || chr(10) ORDER BY doc_rank) AS draft FROM e GROUP BY company"""
    )
    def excerpt_draft(spark, folder):
        """Markdown draft of the best segments per company."""
        chosen = T.spend_budget(T.top_documents(scored(spark, folder), ["company"], 3), ["company"], 3, 12)
        return T.excerpt_draft(chosen.withColumn("task", F.lit(REQUEST)), ["company"], "task")

    @catalog.add(
        f"WITH {DOCS}, {SEGMENTS}, n AS (SELECT doc_id, count(*) AS n FROM segments GROUP BY doc_id) SELECT doc_id, doc_name, 'text' AS doc_type, {Q.clip('text', 180)} AS preview, coalesce(n, 0) AS segment_count, array_to_string(kinds, ',') AS kinds FROM kinds LEFT JOIN n USING (doc_id)"
    )
    def doc_preview(spark, folder):
        """Preview, number of segments and kinds of each document."""
        return T.document_preview(documents(spark, folder), "doc_id")

    evidence_sql = f"""ev AS (SELECT d.doc_id, d.company, doc_name AS title, doc_name AS document, CASE WHEN s.text IS NOT NULL THEN '正文片段 1' ELSE '正文摘要' END AS location,
        {Q.clip('coalesce(s.text, d.text)', 220)} AS excerpt, CASE WHEN s.text IS NOT NULL THEN 'paragraph_1' END AS segment_id FROM docs d LEFT JOIN segments s ON s.doc_id = d.doc_id AND seg_idx = 0)"""

    @catalog.add(f"WITH {DOCS}, {SEGMENTS}, {evidence_sql} SELECT doc_id, title, document, location, excerpt, segment_id FROM ev")
    def doc_evidence(spark, folder):
        """One evidence row per document."""
        return T.document_evidence(documents(spark, folder), "doc_id")

    @catalog.add(
        f"""WITH {DOCS}, {SEGMENTS}, {evidence_sql}, p AS (SELECT company, doc_name AS title, doc_name AS document, '正文定位未标注' AS location, {Q.clip('text', 180)} AS excerpt, NULL AS segment_id FROM docs),
        u AS (SELECT company, title, document, location, excerpt, segment_id FROM ev UNION ALL SELECT * FROM p UNION ALL SELECT company, title, document, location, excerpt, segment_id FROM ev),
        d AS (SELECT *, CASE WHEN segment_id IS NULL THEN 0 ELSE 1 END AS places FROM u WHERE excerpt <> '' GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY places DESC, length(excerpt), title, document, location, excerpt) AS rank FROM d)
        SELECT company, title, document, location, excerpt, segment_id, places, rank FROM r WHERE rank <= 8"""
    )
    def evidence_topk(spark, folder):
        """Best eight evidence rows per company from segments, previews and repeats."""
        docs = documents(spark, folder)
        first = T.document_evidence(docs, "company")
        previews = docs.select(
            "company", F.col("doc_name").alias("title"), F.col("doc_name").alias("document"), F.lit(fixed.NO_LOCATION).alias("location"),
            S.clip("text", fixed.PREVIEW_CHARS).alias("excerpt"), F.lit(None).cast("string").alias("segment_id"),
        )
        return T.merge_evidence(first.unionByName(previews).unionByName(first), ["company"])

    @catalog.add(f"WITH {DOCS} SELECT doc_id, unnest(kinds) AS kind FROM kinds")
    def doc_kinds(spark, folder):
        """Kinds of each document."""
        return documents(spark, folder).select("doc_id", F.explode_outer("kinds").alias("kind"))

    @catalog.add(f"WITH {DOCS} SELECT 'type' AS dimension, 'text' AS name, count(*) AS documents FROM kinds UNION ALL SELECT 'kind', k, count(*) FROM (SELECT unnest(kinds) AS k FROM kinds) GROUP BY k")
    def doc_counts(spark, folder):
        """Documents by type and by kind."""
        return T.document_counts(documents(spark, folder))

    @catalog.add(
        f"""WITH {DOCS}, req AS (SELECT DISTINCT company, k AS kind FROM docs, (VALUES ('licensed'), ('contact'), ('general'), ('prose')) AS r(k) WHERE NOT (company = 'src1' AND k <> 'prose')),
        pres AS (SELECT DISTINCT company, unnest(kinds) AS kind FROM kinds), f AS (SELECT company, count(*) AS documents, count(*) FILTER (length(text) < 20) AS unreadable FROM docs GROUP BY company),
        m AS (SELECT company, coalesce(string_agg(kind, ',' ORDER BY kind), '') AS missing FROM req WHERE NOT EXISTS (SELECT 1 FROM pres WHERE pres.company = req.company AND pres.kind = req.kind) GROUP BY company),
        rr AS (SELECT company, string_agg(kind, ',' ORDER BY kind) AS required FROM req GROUP BY company), pp AS (SELECT company, string_agg(kind, ',' ORDER BY kind) AS present FROM pres GROUP BY company)
        SELECT company, required, present, coalesce(missing, '') AS missing, documents, unreadable, CASE WHEN missing IS NOT NULL OR unreadable > 0 THEN 'partial' ELSE 'ready' END AS readiness
        FROM rr JOIN pp USING (company) JOIN f USING (company) LEFT JOIN m USING (company)"""
    )
    def completeness(spark, folder):
        """Readiness of each company: required, present and missing kinds."""
        docs = documents(spark, folder).withColumn("readable", F.length("text") >= 20)
        required = docs.select("company").distinct().withColumn("kind", F.explode(S.string_array(["licensed", "contact", "general", "prose"]))).where("NOT (company = 'src1' AND kind <> 'prose')")
        return T.completeness(docs, required, "company").select(
            "company", F.array_join("required", ",").alias("required"), F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "documents", "unreadable", "readiness"
        )

    @catalog.add(
        f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN text ELSE '' END AS a, CASE WHEN doc_id % 4 IN (1, 2) THEN text || chr(10) || 'zz' ELSE '' END AS b FROM documents)
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {Q.strip('a')} WHEN 1 THEN {Q.strip('b')} WHEN 2 THEN {Q.strip('b')} ELSE 'summary' END AS text,
               CASE doc_id % 4 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'ocr' ELSE 'summary' END AS kind FROM t"""
    )
    def normalized_text(spark, folder):
        """Text of documents that have a content, a second version, both or only a summary."""
        kind = F.col("doc_id") % 4
        content, second = F.when(kind < 2, F.col("text")), F.when(kind.isin(1, 2), F.concat("text", F.lit("\nzz")))
        return table(spark, folder, "documents", "doc_id").select(
            "doc_id", T.normalized_text(content, second, F.lit("summary")).alias("text"), T.segment_kind(content, second, F.lit("summary")).alias("kind")
        )
