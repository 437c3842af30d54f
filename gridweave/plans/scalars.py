"""Scalar functions, text sources and sinks over the test tables."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.functions import segmentation as G
from gridweave.operators import scaling
from gridweave.plans import sql as Q
from gridweave.plans.catalog import Catalog, table
from gridweave.rules import fixed
from gridweave.sources import cells as C
from gridweave.sources import files, sinks

# Words that occur in the test documents.
DEMO_WORDS = ["license", "apache", "@", "%", "the", "ing"]
# Text of a request per conversation turn: the message and a phrase that depends on the turn.
REQUEST_PHRASES = [
    "请汇总合计金额，生成 ESG 报告 800-1200字",
    "please write a 1.5k words esg report for 2025 q1",
    "check the missing contract and fill template",
    "报销合同对账，核对材料，11月 环比",
    "write the outline section of the sustainability 环境 report",
    "需要 3,000 字 完整报告 治理 excel",
]


def requests(spark, folder):
    """Requests from the conversations: conv_id, turn, request."""
    phrase = F.element_at(S.string_array(REQUEST_PHRASES), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) + 1).cast("int"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), phrase).alias("request"))


REQUESTS = (
    "SELECT conv_id, turn, text || ' ' || CASE (conv_id + turn) % 6 "
    + " ".join(f"WHEN {i} THEN {Q.quote(p)}" for i, p in enumerate(REQUEST_PHRASES))
    + " END AS request FROM conversations"
)

def numbered_line():
    """A sentence with numbers and units from a line item."""
    return F.concat(
        F.lit("discount "), (F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%, quantity "),
        F.col("l_quantity").cast("int").cast("string"), F.lit(" times, price 1,"),
        F.lpad(F.pmod(F.col("l_partkey"), F.lit(1000)).cast("string"), 3, "0"), F.lit(" 吨"),
    )


NUMBERED_LINE_SQL = (
    "'discount ' || CAST(trunc(l_discount * 100) AS INTEGER) || '%, quantity ' || CAST(l_quantity AS INTEGER) || "
    "' times, price 1,' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ' 吨'"
)


def sql_array(words) -> str:
    return "[" + ", ".join(Q.quote(w) for w in words) + "]"


def register(catalog: Catalog) -> None:
    @catalog.add(
        f"""
        WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
        p AS (SELECT doc_id, w, {Q.parse_numeric('w')} AS v FROM w)
        SELECT doc_id, count(*) AS words, count(v) AS numbers, max(v) AS largest, min(v) AS smallest FROM p GROUP BY doc_id"""
    )
    def parse_numeric(spark, folder):
        """Words of each document that are numbers."""
        words = table(spark, folder, "documents", "doc_id").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
        return words.withColumn("v", S.parse_numeric("w")).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("words"), F.count("v").alias("numbers"), F.max("v").alias("largest"), F.min("v").alias("smallest")
        )

    @catalog.add(
        f"""
        WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6
            WHEN 0 THEN '¥' || CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR)
            WHEN 1 THEN CAST(CAST(l_discount * 100 AS INTEGER) AS VARCHAR) || '%'
            WHEN 2 THEN '1,' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || '.5'
            WHEN 3 THEN CAST(l_suppkey AS VARCHAR) || 'd' WHEN 4 THEN '  ' ELSE 'NaN' END AS raw FROM lineitem)
        SELECT l_orderkey, l_linenumber, {Q.parse_numeric('raw')} AS value, {Q.is_empty_like('raw')} AS blank,
               {Q.loose_equal('raw', "'1,005.5'")} AS same FROM v"""
    )
    def cell_values(spark, folder):
        """Numbers written in six ways: parsed value, blank or not, equal to a given number or not."""
        kind = F.col("l_linenumber") % 6
        raw = (
            F.when(kind == 0, F.concat(F.lit("¥"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")))
            .when(kind == 1, F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")))
            .when(kind == 2, F.concat(F.lit("1,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(".5")))
            .when(kind == 3, F.concat(F.col("l_suppkey").cast("string"), F.lit("d")))
            .when(kind == 4, "  ")
            .otherwise("NaN")
        )
        df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
        return df.select(
            "l_orderkey", "l_linenumber", S.parse_numeric("raw").alias("value"), S.is_empty_like("raw").alias("blank"),
            S.loose_equal("raw", F.lit("1,005.5")).alias("same"),
        )

    @catalog.add(f"SELECT doc_id, length({Q.norm('text')}) AS token_chars, md5({Q.norm('text')}) AS token_md5 FROM documents")
    def norm_token(spark, folder):
        """Normalized token of whole texts."""
        token = S.norm_token("text")
        df = table(spark, folder, "documents", "doc_id").select("doc_id", token.alias("t"))
        return df.select("doc_id", F.length("t").alias("token_chars"), F.md5("t").alias("token_md5"))

    @catalog.add(
        f"""
        SELECT o_orderkey, {Q.a1('o_orderkey + 1', '(o_custkey % 18278 + 1)')} AS cell, CAST(o_custkey % 18278 + 1 AS INTEGER) AS column_back,
               CAST(o_orderkey + 1 AS INTEGER) AS row_back, true AS valid FROM orders"""
    )
    def a1_codec(spark, folder):
        """Addresses from row and column numbers, and back."""
        df = table(spark, folder, "orders").select(
            "o_orderkey", S.a1_encode(F.col("o_orderkey") + 1, F.col("o_custkey") % 18278 + 1).alias("cell")
        )
        return df.select(
            "o_orderkey", "cell", S.a1_column("cell").alias("column_back"), S.a1_row("cell").alias("row_back"), S.is_a1("cell").alias("valid")
        )

    @catalog.add(
        f"""
        SELECT doc_id, {Q.clip('text', 180)} AS preview, {Q.clip('text', 220)} AS excerpt, length({Q.strip('text')}) > 5000 AS too_long,
               substr({Q.strip('text')}, 1, 5000) = {Q.strip('text')} AS unchanged FROM documents"""
    )
    def clip_preview(spark, folder):
        """Preview and excerpt of each document, and the flag of an upload limit."""
        body, too_long = S.flag_long_text("text", 5000)
        return table(spark, folder, "documents", "doc_id").select(
            "doc_id", S.clip("text", fixed.PREVIEW_CHARS).alias("preview"), S.clip("text").alias("excerpt"),
            too_long.alias("too_long"), (body == S.strip("text")).alias("unchanged"),
        )

    @catalog.add(
        r"""
        WITH t AS (SELECT doc_id, translate(text, '#*_>`-|[]()', '           ') AS t FROM documents)
        SELECT doc_id, CAST(len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(t, '[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*')) AS INTEGER) AS words
        FROM t"""
    )
    def word_count(spark, folder):
        """Words of each document, CJK characters counted one by one."""
        return table(spark, folder, "documents", "doc_id").select("doc_id", S.word_count("text").alias("words"))

    pattern = S.number_pattern()

    @catalog.add(
        f"""
        WITH s AS (SELECT 'd' || doc_id AS id, text AS t FROM documents
                   UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, {NUMBERED_LINE_SQL} FROM lineitem),
        p AS (SELECT id, unnest(regexp_extract_all(t, {Q.quote(pattern)}, 1)) AS n, unnest(regexp_extract_all(t, {Q.quote(pattern)}, 2)) AS u,
                     generate_subscripts(regexp_extract_all(t, {Q.quote(pattern)}, 1), 1) AS i FROM s)
        SELECT id, CAST(i AS INTEGER) AS position, CAST(replace(n, ',', '') AS DOUBLE) AS value,
               CASE WHEN lower(coalesce(u, '')) IN ('times', 'time', 'meeting', 'meetings') THEN '次' ELSE lower(coalesce(u, '')) END AS unit FROM p"""
    )
    def number_units(spark, folder):
        """All numbers with units in the documents and in sentences made from lineitem."""
        texts = table(spark, folder, "documents", "doc_id").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("t"))
        lines = table(spark, folder, "lineitem", "l_orderkey").select(
            F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), numbered_line().alias("t")
        )
        return texts.unionByName(lines).select("id", F.posexplode_outer(S.number_units("t")).alias("position", "n")).where("position IS NOT NULL").select(
            "id", (F.col("position") + 1).alias("position"), "n.value", "n.unit"
        )

    @catalog.add(
        f"""
        WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), k AS (SELECT unnest({sql_array(DEMO_WORDS)}) AS keyword)
        SELECT doc_id, keyword, {Q.occurrences('t', 'keyword')} AS hits FROM t, k WHERE contains(t, keyword)"""
    )
    def keyword_hits(spark, folder):
        """Which of a few keywords occur in which document, and how often."""
        df = table(spark, folder, "documents", "doc_id").select("doc_id", F.lower("text").alias("t"))
        found = df.select("doc_id", "t", F.explode_outer(S.keywords_found(F.col("t"), DEMO_WORDS)).alias("keyword")).where("keyword IS NOT NULL")
        return found.select("doc_id", "keyword", S.occurrences(F.col("t"), F.col("keyword")).alias("hits"))

    @catalog.add(
        f"""
        WITH n AS (SELECT DISTINCT lower(p_name) AS keyword FROM part),
        t AS (SELECT p_partkey, lower(p_type || ' ' || p_name || ' ' || p_name || ' of ' || p_brand) AS t FROM part)
        SELECT p_partkey, keyword, {Q.occurrences('t', 'keyword')} AS hits FROM t, n WHERE contains(t, keyword)"""
    )
    def keyword_table_hits(spark, folder):
        """Occurrences of a keyword table that grows with the data, by an equi-join on the first characters."""
        part = table(spark, folder, "part")
        words = part.select(F.lower("p_name").alias("keyword")).distinct()
        text = F.concat_ws(" ", "p_type", "p_name", "p_name", F.lit("of"), "p_brand")
        return scaling.find_keywords(part.select("p_partkey", text.alias("t")), "t", words, "keyword", "p_partkey")

    ka, kb = "lower(" + Q.squeeze("a") + ")", "lower(" + Q.squeeze("b") + ")"
    extra = f"list_filter({Q.lines('b')}, lambda l: NOT list_contains(list_transform({Q.lines('a')}, lambda m: lower({Q.squeeze('m')})), lower({Q.squeeze('l')})))"
    longer = "CASE WHEN length(a) >= length(b) THEN a ELSE b END"
    merge_pairs = """
        SELECT a.conv_id, a.turn, a.text AS x, CASE a.turn % 3 WHEN 0 THEN b.text WHEN 1 THEN replace(a.text, ' ', '  ') || chr(10) || b.text ELSE substr(a.text, 5, 20) END AS y
        FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""

    @catalog.add(
        f"""
        WITH p AS ({merge_pairs}), s AS (SELECT conv_id, turn, {Q.strip("coalesce(x, '')")} AS a, {Q.strip("coalesce(y, '')")} AS b FROM p),
        k AS (SELECT *, {ka} AS ka, {kb} AS kb, {extra} AS extra FROM s)
        SELECT conv_id, turn, CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN ka = kb THEN {longer} WHEN contains(ka, kb) THEN a WHEN contains(kb, ka) THEN b
               WHEN len(extra) = 0 THEN {longer}
               ELSE {Q.strip("a || chr(10) || chr(10) || '[补全文本]' || chr(10) || array_to_string(extra, chr(10))")} END AS merged FROM k"""
    )
    def merge_text(spark, folder):
        """Each message merged with a second version: the next message, a repeat with more, or a part of it."""
        talk = table(spark, folder, "conversations")
        after = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
        kind = F.col("turn") % 3
        second = F.when(kind == 0, F.col("next")).when(
            kind == 1, F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"), F.col("next"))
        ).otherwise(F.substring("text", 5, 20))
        return talk.join(after, ["conv_id", "turn"], "left").select(
            "conv_id", "turn", S.merge_text(F.col("text"), second, "补全文本").alias("merged")
        )

    @catalog.add(
        """
        WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type FROM events),
        r AS (SELECT event_id, k, event_type, CASE WHEN k % 4 = 0 THEN 'odd' WHEN k % 4 = 1 THEN 'low' WHEN k % 4 = 2 THEN 'medium' ELSE 'high' END AS raw_risk FROM e),
        v AS (SELECT event_id, event_type <> 'error' AS valid, CASE WHEN raw_risk = 'odd' THEN 'medium' ELSE raw_risk END AS risk,
                     CASE WHEN event_type = 'click' THEN NULL ELSE k % 2 = 0 END AS approved FROM r)
        SELECT event_id, CASE WHEN valid THEN 'completed' ELSE 'invalid_response' END AS status,
               CASE WHEN valid THEN risk ELSE 'unknown' END AS risk_level,
               CASE WHEN valid THEN coalesce(approved, risk <> 'high') AND NOT (risk = 'high' OR NOT coalesce(approved, risk <> 'high')) ELSE false END AS approved,
               CASE WHEN valid THEN risk = 'high' OR NOT coalesce(approved, risk <> 'high') ELSE true END AS block FROM v"""
    )
    def props_json(spark, folder):
        """Verdicts from replies built of event properties: fenced, with odd risk names, or broken."""
        k = F.from_json("props", "k INT")["k"]
        risk = F.element_at(S.string_array(["odd", "low", "medium", "high"]), F.col("k") % 4 + 1)
        approved = F.when(F.col("event_type") == "click", "").otherwise(
            F.concat(F.lit('"approved": '), (F.col("k") % 2 == 0).cast("string"), F.lit(", "))
        )
        close = F.when(F.col("event_type") == "error", "").otherwise("}")
        reply = F.concat(F.lit("```json\n{"), approved, F.lit('"riskLevel": "'), risk, F.lit('"'), close, F.lit("\n```"))
        df = table(spark, folder, "events").select("event_id", "event_type", k.alias("k")).withColumn("v", S.verdict(reply))
        return df.select("event_id", "v.status", "v.risk_level", "v.approved", "v.block")

    suffix_sql = "regexp_extract(lower(name), '[^./]\\.([^./]+)$', 1)"

    @catalog.add(
        f"""
        WITH n AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.eml'
                   WHEN 4 THEN '.md' WHEN 5 THEN '.html' WHEN 6 THEN '.zip' ELSE '' END AS name,
                   CASE page_id % 16 WHEN 7 THEN 'application/msword' WHEN 15 THEN 'application/ld+json' END AS mime FROM pages)
        SELECT page_id, CASE WHEN {suffix_sql} = 'pdf' THEN 'pdf' WHEN {suffix_sql} = 'jpg' THEN 'image' WHEN {suffix_sql} = 'xlsx' THEN 'excel'
            WHEN contains(coalesce(mime, ''), 'word') THEN 'word' WHEN {suffix_sql} = 'eml' THEN 'email' WHEN {suffix_sql} = 'zip' THEN 'archive'
            WHEN {suffix_sql} = 'md' THEN 'note' WHEN {suffix_sql} = 'html' OR mime LIKE '%+json' THEN 'text' ELSE 'other' END AS doc_type FROM n"""
    )
    def doc_type(spark, folder):
        """Document type from file name and MIME type."""
        endings = [".pdf", ".JPG", ".xlsx", ".eml", ".md", ".html", ".zip", ""]
        name = F.concat(
            F.regexp_replace("url", "[?#].*$", ""), F.element_at(S.string_array(endings), (F.col("page_id") % 8 + 1).cast("int"))
        )
        mime = F.when(F.col("page_id") % 16 == 7, "application/msword").when(F.col("page_id") % 16 == 15, "application/ld+json")
        return table(spark, folder, "pages", "page_id").select("page_id", S.document_type(name, mime).alias("doc_type"))

    # The same rules for an engine without look-around: tags end outside quoted values, script and style bodies stand as
    # they are, references are those of the HTML standard (names from the standard library's table).
    tag_rest = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*?>"""
    raw = "|".join(rf"<{n}(?:[\s/]{tag_rest}|>)(.*?)(?:</{n}(?:[\s/]{tag_rest}|>)|\z)" for n in ("script", "style"))
    between = Q.quote(rf"(?is){raw}|<!--.*?(?:-->|\z)|<[!?][^>]*>|</?[a-z]{tag_rest}|</[^a-z>][^>]*>")
    names = "MAP([" + ", ".join(Q.quote(n) for n in html5) + "], [" + ", ".join(Q.quote(c) for c in html5.values()) + "])"
    code = "CASE WHEN lower(substr(r, 2, 1)) = 'x' THEN CAST('0x' || regexp_extract(r, '^#[xX]0*([0-9a-fA-F]{1,7})', 1) AS BIGINT) ELSE CAST(regexp_extract(r, '^#0*([0-9]{1,7})', 1) AS BIGINT) END"
    numbered = f"list_transform([{code}], lambda c: CASE WHEN c BETWEEN 128 AND 159 THEN substr({Q.quote(files.WINDOWS_1252)}, c - 127, 1) WHEN c BETWEEN 1 AND 8 OR c IN (11, 127) OR c BETWEEN 14 AND 31 THEN '' ELSE chr(CAST(c AS INTEGER)) END)[1]"
    begins = f"regexp_extract(r, {Q.quote(files.OPEN_NAMES)}, 1)"
    refers = f"CASE WHEN r[1] = '#' THEN {numbered} ELSE coalesce(m[r], CASE WHEN {begins} <> '' THEN m[{begins}] || substr(r, length({begins}) + 1) END, '&' || r) END"
    reference = Q.quote("&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)")
    referred = f"list_reduce(list_prepend('', flatten(list_transform(range(1, len(gaps) + 1), lambda i: [gaps[i], coalesce(said[i], '')]))), lambda x, y: x || y)"

    @catalog.add(
        f"""
        WITH names AS MATERIALIZED (SELECT {names} AS m),
        cut AS (SELECT page_id, regexp_split_to_array(coalesce(html, ''), {between}) AS nodes, regexp_extract_all(coalesce(html, ''), {between}, 1) AS b1, regexp_extract_all(coalesce(html, ''), {between}, 2) AS b2 FROM pages),
        n AS (SELECT page_id, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS i FROM cut),
        g AS (SELECT page_id, i, regexp_split_to_array(node, {reference}) AS gaps, list_transform(regexp_extract_all(node, {reference}, 1), lambda r: {refers}) AS said FROM n, names),
        text AS (SELECT page_id, 2 * i AS i, {Q.strip(referred)} AS x, false AS body FROM g
          UNION ALL SELECT page_id, 2 * i + 1, {Q.strip('b')}, true FROM (SELECT page_id, coalesce(x, '') || coalesce(y, '') AS b, i FROM (SELECT page_id, unnest(b1) AS x, unnest(b2) AS y, generate_subscripts(b1, 1) AS i FROM cut))),
        t AS (SELECT page_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (x <> ''), '') AS t, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (x <> '' AND NOT body), '') AS shown FROM text GROUP BY page_id)
        SELECT page_id, length(t) AS chars, md5(t) AS text_md5, length(shown) AS shown_chars, md5(shown) AS shown_md5, {Q.clip('shown', 220)} AS excerpt FROM t"""
    )
    def html_text(spark, folder):
        """Text of the pages: once as it is, once without script and style bodies."""
        pages = table(spark, folder, "pages", "page_id").select("page_id", files.html_to_text(F.col("html")).alias("t"), files.html_to_text(F.col("html"), drop_script=True).alias("shown"))
        return pages.select(
            "page_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"), F.length("shown").alias("shown_chars"), F.md5("shown").alias("shown_md5"), S.clip("shown", 220).alias("excerpt")
        )

    @catalog.add(
        f"""
        WITH r AS (SELECT o_orderpriority, 'orders' AS doc_name, o_orderstatus AS sheet, count(*) AS value FROM orders GROUP BY ALL)
        SELECT o_orderpriority, {Q.quote(fixed.MARKDOWN_TITLE)} || chr(10) || chr(10) || '| 文档 | 工作表 | 指标 | 结果 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
               || string_agg('| ' || doc_name || ' | ' || sheet || ' | count | ' || value || ' |', chr(10) ORDER BY sheet) AS markdown
        FROM r GROUP BY o_orderpriority"""
    )
    def markdown_report(spark, folder):
        """One Markdown result table per order priority."""
        rows = table(spark, folder, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("sheet")).agg(
            F.count(F.lit(1)).alias("value")
        )
        headers = [fixed.RESULT_HEADERS[c] for c in ("doc_name", "sheet", "metric", "value")]
        columns = [F.lit("orders"), F.col("sheet"), F.lit("count"), F.col("value")]
        return sinks.markdown_table(rows, ["o_orderpriority"], F.col("sheet"), headers, columns)

    @catalog.add(
        """
        SELECT 'doc_' || doc_id || '.md' AS name, CAST(octet_length(encode(text)) AS INTEGER) AS size_bytes, sha256(text) AS sha256,
               'text/markdown; charset=utf-8' AS mime_type, 'note' AS doc_type FROM documents"""
    )
    def manifest(spark, folder):
        """Size and hash of each document as a file."""
        df = table(spark, folder, "documents", "doc_id").select(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md")).alias("file"), "text")
        return sinks.manifest(df, "file", "text")

    part_columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]

    @catalog.add(
        f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in part_columns[:5])}, p_brand AS sheet, p_partkey + 2 AS row_idx, p_retailprice AS price_num FROM part"
    )
    def grid_roundtrip(spark, folder):
        """A table as cells and back, with the typed value of one column."""
        cells = C.to_cells(table(spark, folder, "part", "p_partkey"), F.lit("part"), F.col("p_brand"), F.col("p_partkey") + 2, part_columns)
        wide = cells.groupBy("sheet", "row_idx").agg(
            *[F.max(F.when(F.col("header") == h, F.col("value_str"))).alias(h) for h in part_columns[:5]],
            F.max(F.when(F.col("header") == "p_retailprice", F.col("value_num"))).alias("price_num"),
        )
        return wide

    @catalog.add(
        f"""
        WITH r AS ({REQUESTS}), t AS (SELECT conv_id, turn, lower(request) AS t FROM r)
        SELECT conv_id, turn,
          array_to_string(list_filter({sql_array(fixed.TIME_TOKENS)}, lambda w: contains(t, w)), ',') AS time_tokens,
          array_to_string(list_filter([{', '.join(f"CASE WHEN {Q.contains_any('t', ws)} THEN {Q.quote(n)} END" for n, ws in fixed.OPERATION_KEYWORDS.items())}], lambda w: w IS NOT NULL), ',') AS operations
        FROM t"""
    )
    def request_operations(spark, folder):
        """Time tokens and operations named in the requests."""
        ops = S.labels_found("lower(request)", fixed.OPERATION_KEYWORDS)
        return requests(spark, folder).select(
            "conv_id", "turn", F.array_join(S.time_tokens("request"), ",").alias("time_tokens"), F.array_join(ops, ",").alias("operations")
        )

    labels_sql = f"list_filter([{', '.join(f'CASE WHEN ' + Q.contains_any('t', ws) + f' THEN {Q.quote(n)} END' for n, ws in fixed.MESSAGE_LABELS.items())}], lambda w: w IS NOT NULL)"

    @catalog.add(
        f"""
        WITH r AS ({REQUESTS}), t AS (SELECT conv_id, turn, lower(request) AS t FROM r), f AS (SELECT *, {labels_sql} AS found FROM t),
        c AS (SELECT *, CASE WHEN NOT list_contains(found, 'count') AND {Q.contains_any('t', fixed.CALCULATION_WORDS)} THEN list_append(found, 'count') ELSE found END AS counted FROM f),
        l AS (SELECT *, CASE WHEN len(counted) = 0 THEN ['general'] ELSE counted END AS labels FROM c)
        SELECT conv_id, turn, array_to_string(labels, ',') AS labels, labels[1] AS primary_label,
               CASE WHEN labels = ['general'] THEN 0.62 WHEN len(labels) > 1 THEN 0.86 ELSE 0.8 END::DOUBLE AS confidence FROM l"""
    )
    def message_labels(spark, folder):
        """Labels of each message in fixed order, the first one, and the confidence."""
        df = requests(spark, folder).withColumn("l", S.message_labels("request"))
        return df.select(
            "conv_id", "turn", F.array_join("l", ",").alias("labels"), F.element_at("l", 1).alias("primary_label"),
            S.label_confidence(F.col("l"), F.lit(False)).alias("confidence"),
        )

    def count_sql(value: str, unit: str) -> str:
        return (
            f"CAST(round_even(CAST(replace({value}, ',', '') AS DOUBLE) * CASE WHEN {unit} = '万' THEN 10000 "
            f"WHEN lower({unit}) IN ('千', 'k') THEN 1000 ELSE 1 END, 0) AS INTEGER)"
        )

    rp, sp = Q.quote(fixed.LENGTH_RANGE_PATTERN), Q.quote(fixed.LENGTH_PATTERN)
    length_sql = f"""
        len AS (SELECT conv_id, turn, request, lower(request) AS t,
            CASE WHEN regexp_matches(request, {rp}) THEN {count_sql(f"regexp_extract(request, {rp}, 1)", "''")} END AS f1,
            CASE WHEN regexp_matches(request, {rp}) THEN {count_sql(f"regexp_extract(request, {rp}, 2)", "''")} END AS f2,
            CASE WHEN regexp_matches(request, {sp}) THEN {count_sql(f"regexp_extract(request, {sp}, 1)", f"regexp_extract(request, {sp}, 2)")} END AS f3 FROM r),
        lim AS (SELECT *, CASE WHEN f1 > 0 AND f2 > 0 THEN 'range' WHEN f3 > 0 THEN 'one' ELSE 'none' END AS kind,
            greatest(300, least(f1, f2)) AS lo, least(20000, greatest(f1, f2)) AS hi, least(20000, greatest(300, f3)) AS tgt FROM len)"""

    @catalog.add(
        f"""
        WITH r AS ({REQUESTS}), {length_sql}
        SELECT conv_id, turn, kind <> 'none' AS explicit,
          CAST(CASE kind WHEN 'range' THEN round_even((lo + hi) / 2.0, 0) WHEN 'one' THEN tgt ELSE 3000 END AS INTEGER) AS target,
          CAST(CASE kind WHEN 'range' THEN lo WHEN 'one' THEN greatest(300, tgt - greatest(120, CAST(round_even(tgt * 0.1::DOUBLE, 0) AS INTEGER))) ELSE 2700 END AS INTEGER) AS lower,
          CAST(CASE kind WHEN 'range' THEN hi WHEN 'one' THEN least(20000, tgt + greatest(120, CAST(round_even(tgt * 0.1::DOUBLE, 0) AS INTEGER))) ELSE 3300 END AS INTEGER) AS upper
        FROM lim"""
    )
    def length_requirement(spark, folder):
        """Report length asked for in each request."""
        df = requests(spark, folder).withColumn("l", S.length_requirement("request"))
        return df.select("conv_id", "turn", "l.explicit", "l.target", "l.lower", "l.upper")

    def any_sql(words) -> str:
        return Q.contains_any("t", words)

    writes_sql = (
        f"({any_sql(fixed.TOPIC_REQUEST_WORDS)} AND {any_sql(fixed.REPORT_WORDS)} AND ({any_sql(fixed.FULL_REPORT_HINTS)} OR kind <> 'none' OR "
        f"({any_sql(fixed.REPORT_WRITING_WORDS)} AND NOT {any_sql(fixed.OUTLINE_WORDS)} AND NOT {any_sql(fixed.SECTION_ONLY_HINTS)})))"
    )
    counted = f"({any_sql(fixed.MESSAGE_LABELS['count'])} OR {any_sql(fixed.CALCULATION_WORDS)})"

    @catalog.add(
        f"""
        WITH r AS ({REQUESTS}), {length_sql}
        SELECT conv_id, turn, {any_sql(fixed.TOPIC_REQUEST_WORDS)} AS is_topic_request,
          {any_sql(fixed.MESSAGE_LABELS['check_missing'])} OR {any_sql(fixed.GAP_WORDS)} AS checks_material,
          {counted} OR {any_sql(fixed.KPI_WORDS)} AS extracts_kpis,
          {any_sql(fixed.MESSAGE_LABELS['revise'])} OR {any_sql(fixed.OUTLINE_WORDS)} AS wants_outline,
          {writes_sql} AS writes_report,
          {any_sql(fixed.TABLE_FILL_WORDS)} OR ({any_sql(fixed.TABLE_TARGET_WORDS)} AND {any_sql(fixed.WRITE_WORDS)}) AS fills_table,
          {writes_sql} OR {any_sql(fixed.DOCUMENT_REFERENCE_WORDS)} AS needs_documents
        FROM lim"""
    )
    def request_flags(spark, folder):
        """What each request asks for."""
        flags = S.request_flags("request")
        return requests(spark, folder).select("conv_id", "turn", *[c.alias(n) for n, c in flags.items()])

    kind_groups = ", ".join(
        f"CASE WHEN {any_sql([w])}{' AND NOT ' + writes_sql if w in fixed.REPORT_KIND_WORDS else ''} THEN {sql_array(ks)} ELSE [] END"
        for w, ks in fixed.REQUIRED_KINDS.items()
    )

    @catalog.add(
        f"""
        WITH r AS ({REQUESTS}), {length_sql}, k AS (SELECT DISTINCT conv_id, turn, unnest(flatten([{kind_groups}])) AS kind FROM lim)
        SELECT conv_id, turn, kind FROM k"""
    )
    def required_kinds(spark, folder):
        """Document kinds each request needs."""
        return requests(spark, folder).select("conv_id", "turn", F.explode_outer(S.required_kinds("request")).alias("kind")).where("kind IS NOT NULL")

    stop_words = sql_array(fixed.REQUEST_STOP_WORDS)
    cjk = r"[\x{4e00}-\x{9fff}]"

    @catalog.add(
        f"""
        WITH r AS ({REQUESTS}),
        k AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(request), '[a-z0-9][a-z0-9_/-]+|{cjk}{{2,}}')) AS raw,
                     generate_subscripts(regexp_extract_all(lower(request), '[a-z0-9][a-z0-9_/-]+|{cjk}{{2,}}'), 1) AS i FROM r),
        t AS (SELECT conv_id, turn, i, trim(raw, '-_/') AS w FROM k),
        e AS (SELECT conv_id, turn, i, unnest(x) AS w, generate_subscripts(x, 1) AS j FROM (SELECT *, CASE WHEN regexp_matches(w, '^{cjk}+$') AND length(w) > 2
              THEN list_concat(list_transform(range(1, length(w)), lambda p: substr(w, p, 2)), CASE WHEN length(w) <= 4 THEN [w] ELSE [] END) ELSE [w] END AS x FROM t WHERE w <> '')),
        d AS (SELECT conv_id, turn, w, min(i * 1000 + j) AS o FROM e WHERE NOT list_contains({stop_words}, w) GROUP BY ALL)
        SELECT conv_id, turn, string_agg(w, ' ' ORDER BY o) AS keywords, count(*) AS n FROM d GROUP BY conv_id, turn"""
    )
    def keywords(spark, folder):
        """Keywords of each request in order."""
        df = requests(spark, folder).withColumn("k", G.request_keywords("request")).where(F.size("k") > 0)
        return df.select("conv_id", "turn", F.array_join("k", " ").alias("keywords"), F.size("k").cast("bigint").alias("n"))

    @catalog.add(
        f"""
        WITH c AS (SELECT conv_id, count(*) AS n, max(turn) AS top FROM conversations GROUP BY conv_id)
        SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, {Q.strip('text')} AS text FROM conversations JOIN c USING (conv_id) WHERE n = top + 1 AND conv_id % 5 <> 0"""
    )
    def page_split(spark, folder):
        """Pages of a marked text per conversation; nothing where a page of several is missing (every fifth lacks its first)."""
        talk = table(spark, folder, "conversations")
        marker = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[page "), F.col("turn") + 1, F.lit("]"))).otherwise(
            F.concat(F.lit("[第 "), F.col("turn") + 1, F.lit(" 页]"))
        )
        marker = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), F.lit("[no page]")).otherwise(marker)
        page = F.struct("turn", F.concat(marker, F.lit("\n"), F.col("text")).alias("t"))
        books = talk.groupBy("conv_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["t"]), "\n").alias("text"),
            (F.max("turn") + 1).cast("int").alias("pages"),
        )
        # A text of one expected page is that page, with or without a marker.
        split = S.split_pages(F.col("text"), F.lit(1), F.greatest(F.col("pages"), F.lit(1)))
        return books.select("conv_id", F.explode_outer(split).alias("page", "raw")).where("page IS NOT NULL").select(
            "conv_id", "page", F.when(F.startswith("raw", F.lit("[page")), S.strip(F.regexp_replace("raw", r"^\[page 1\]\n", ""))).otherwise(F.col("raw")).alias("text")
        )

    @catalog.add(
        """
        SELECT l_orderkey, l_linenumber,
          array_to_string(list_filter([CASE WHEN l_linenumber % 2 = 0 THEN '第 ' || l_linenumber || ' 页' END, CASE WHEN l_returnflag <> 'A' THEN '章节 ' || l_returnflag END,
            '工作表 ' || l_linestatus, CASE WHEN l_quantity > 10 THEN CASE WHEN l_quantity = 25 THEN '第 25 行' ELSE '第 25-' || CAST(l_quantity AS INTEGER) || ' 行' END END], lambda p: p IS NOT NULL), ' / ') AS location,
          CASE WHEN l_returnflag = 'N' THEN '-' ELSE l_returnflag || '\\|' || l_linestatus END AS cell, l_returnflag || ' / ' || l_linestatus AS source
        FROM lineitem"""
    )
    def location_text(spark, folder):
        """Place in words, escaped Markdown cell and joined source of each line."""
        quantity = F.col("l_quantity").cast("int")
        place = S.location_text(
            page=F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")),
            section=F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise(""),
            sheet=F.col("l_linestatus"), row_start=F.when(quantity > 10, F.lit(25)), row_end=F.when(quantity > 10, quantity),
        )
        cell = F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", F.lit("|"), "l_linestatus", F.lit("\n")))
        return table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", place.alias("location"), S.md_cell(cell).alias("cell"),
            S.join_present(" / ", F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("source"),
        )

    @catalog.add(
        """
        WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS w, generate_subscripts(regexp_split_to_array(text, '[ \\n]'), 1) AS i FROM documents),
        d AS (SELECT doc_id, trim(w) AS w, min(i) AS i FROM w WHERE trim(w) <> '' GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM d)
        SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM r WHERE n <= 6 GROUP BY doc_id"""
    )
    def ordered_distinct(spark, folder):
        """First six different words of each document in order."""
        words = F.split("text", "[ \\n]")
        df = table(spark, folder, "documents", "doc_id").withColumn("w", S.ordered_distinct(words, 6)).where(F.size("w") > 0)
        return df.select("doc_id", F.array_join("w", " ").alias("words"))
