"""File sources: whole files as rows, and their texts, cells and mail parts.

HTML and CSV are column expressions. Spark decodes only some charsets and has no mail reader, so two small
helpers for one file run inside `mapInPandas`: the choice of a charset and the standard library's mail parser.
A file is named by its whole path, and a file that cannot be read gives a row that says so.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.rules import fixed


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows: doc_id (the path), doc_name (its last part), size, content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    place = F.url_decode(F.col("path"))
    return raw.select(place.alias("doc_id"), F.element_at(F.split(place, "/"), -1).alias("doc_name"), F.col("length").alias("size"), "content")


# --- text -------------------------------------------------------------------------------------


def clarity(data: bytes, charset: str) -> float:
    """Share of characters a reader could see when `data` is read as `charset`; -1 if it cannot be read so."""
    text = data.decode(charset, "replace")
    if text.encode(charset, "replace") != data and "�" in text:
        return -1.0
    seen = pd.Series(list(text)).map(lambda c: c.isprintable() or c.isspace()) if text else pd.Series([True])
    return float(seen.mean())


def charset_of(data: bytes) -> str | None:
    """The preferred charset among those that read `data` clearly, or None."""
    candidates = pd.Series({c: clarity(data, c) for c in [*fixed.TEXT_ENCODINGS, fixed.FALLBACK_ENCODING]})
    clear = candidates[candidates >= fixed.PRINTABLE_SHARE]
    return clear.index[0] if len(clear) else None


def text_files(files: DataFrame) -> DataFrame:
    """Files to documents: doc_id, doc_name, size, text, error, doc_type, decoded.

    Valid UTF-8 is decoded in the JVM; other files go through the choice of a charset. A file that no charset
    reads has a null text and an error.
    """
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    plain = files.where(utf8).select("doc_id", "doc_name", "size", F.decode("content", "UTF-8").alias("text"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            charsets = [charset_of(bytes(data)) for data in batch["content"]]
            texts = [None if c is None else bytes(data).decode(c) for data, c in zip(batch["content"], charsets, strict=True)]
            yield batch[["doc_id", "doc_name", "size"]].assign(text=texts)

    other = files.where(~utf8).mapInPandas(decode, "doc_id string, doc_name string, size long, text string")
    read = F.col("text").isNotNull()
    return plain.unionByName(other).withColumns({"error": F.when(~read, "no charset reads this file"), "doc_type": S.document_type("doc_name"), "decoded": read})


# --- HTML -------------------------------------------------------------------------------------

# The rest of a tag up to its end, which is not inside a quoted value; runs are possessive, so a tag costs its length.
TAG_END = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=\s*+[^\s>"'][^\s>]*+|=)*+>"""
# What parts text nodes: script and style with their bodies (group 2), comments, declarations, tags.
BETWEEN_NODES = (
    rf"(?is)<(script|style)(?=[\s/>]){TAG_END}(?<!/>)(.*?)(?:</\1(?=[\s/>]){TAG_END}|\z)"
    rf"|<!--(?:-?>|.*?(?:--!?>|\z))|<[!?][^>]*+>|</?[a-z]{TAG_END}|</(?![a-z])[^>]*+>"
)
REFERENCE = "&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
# Names that count without a semicolon as well, the longest first.
OPEN_NAMES = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
# References to 128..159 mean the characters of Windows-1252.
WINDOWS_1252 = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))


def html_to_text(html: Column, drop_script: bool = False) -> Column:
    """Text nodes of a page, trimmed, one space between them; as column expression.

    Bodies of script and style are text as they stand unless dropped. Comments, declarations and tags part text
    nodes. Character references, named or by number, are read as HTML 5 does.
    """
    page = F.coalesce(html, F.lit(""))
    nodes = F.transform(F.split(page, BETWEEN_NODES), lambda n: S.strip(_referred(n)))
    if not drop_script:
        bodies = F.transform(F.regexp_extract_all(page, F.lit(BETWEEN_NODES), F.lit(2)), lambda b: S.strip(b))
        nodes = F.flatten(F.zip_with(nodes, bodies, lambda n, b: F.array(n, F.coalesce(b, F.lit("")))))
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


def _referred(text: Column) -> Column:
    """`text` with its character references turned, each once."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    turned = F.zip_with(F.split(text, REFERENCE), found, lambda gap, name: F.concat(gap, F.coalesce(_reference(name), F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(turned, "")).otherwise(text)


def _reference(name: Column) -> Column:
    """The characters that `name` (what follows the ampersand) refers to; names that are not known stay as written."""
    known = F.str_to_map(F.lit("\x02".join(f"{n}\x01{c}" for n, c in html5.items())), F.lit("\x02"), F.lit("\x01"))
    begins = F.regexp_extract(name, OPEN_NAMES, 1)
    named = F.coalesce(known[name], F.when(begins != "", F.concat(known[begins], F.substr(name, F.length(begins) + 1))), F.concat(F.lit("&"), name))
    digits = F.regexp_extract(name, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    base = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits)
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).when(digits == "", F.lit(0)).otherwise(base.cast("int"))
    unseen = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | ((code < 0x110000) & (code % 0x10000 >= 0xFFFE))
    number = F.when(code.between(128, 159), F.substr(F.lit(WINDOWS_1252), code - 127, F.lit(1))).when(unseen, F.lit("")).otherwise(_character(code))
    return F.when(F.startswith(name, F.lit("#")), number).when(name.isNotNull(), named)


def _character(code: Column) -> Column:
    """The character of a code point, through its UTF-32 bytes; beyond Unicode the replacement character."""
    known = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), code).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")


def html_text(pages: DataFrame, key: str, html: str, drop_script: bool = False) -> DataFrame:
    """Text of HTML pages by key."""
    return pages.select(key, html_to_text(F.col(html), drop_script).alias("text"))


# --- mail -------------------------------------------------------------------------------------


def mail_files(files: DataFrame) -> DataFrame:
    """Mail files: doc_id, doc_name, header (subject, sender, receiver), body (the plain one, else the HTML one as text)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mails = [email.message_from_bytes(bytes(data), policy=email.policy.default) for data in batch["content"]]
            bodies = [m.get_body(preferencelist=("plain", "html")) for m in mails]
            yield batch[["doc_id", "doc_name"]].assign(
                heads=[[str(m[name] or "") for name in ("subject", "from", "to")] for m in mails],
                body=["" if b is None else b.get_content() for b in bodies], is_html=[b is not None and b.get_content_subtype() == "html" for b in bodies],
            )

    read = files.select("doc_id", "doc_name", "content").mapInPandas(split, "doc_id string, doc_name string, heads array<string>, body string, is_html boolean")
    names = S.string_array(fixed.MAIL_HEADS)
    lines = F.filter(F.zip_with(names, "heads", lambda name, value: F.when(value != "", F.concat(name, F.lit("："), value))), lambda x: x.isNotNull())
    return read.select("doc_id", "doc_name", F.array_join(lines, "\n").alias("header"), F.when(F.col("is_html"), html_to_text(F.col("body"))).otherwise(F.col("body")).alias("body"))


# --- CSV --------------------------------------------------------------------------------------

FIELD = r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'


def csv_cells(files: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """CSV files to cells: doc_id, doc_name, sheet (the name without ending), row_idx, col_idx, value_str, value_num, value_kind, error.

    A record goes on over line ends while its quotes are open. A file that no charset reads gives one row with
    an error and no cell. The caps are upload limits, off by default.
    """
    texts = text_files(files).select("doc_id", "doc_name", "text", "error")
    lines = texts.where("text IS NOT NULL").select("doc_id", "doc_name", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "part"))
    quotes = F.length("part") - F.length(F.replace(F.col("part"), F.lit('"'), F.lit("")))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("open", F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2 == 1)
    through = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("row_idx", F.sum((~F.col("open")).cast("int")).over(through).cast("int"))
    records = numbered.groupBy("doc_id", "doc_name", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "\n").alias("record"))
    fields = records.where("record <> ''").select("doc_id", "doc_name", "row_idx", F.posexplode(F.regexp_extract_all("record", F.lit(FIELD), F.lit(1))).alias("c", "field"))
    quoted = F.regexp_extract("field", r'(?s)^"(.*)"', 1)
    raw = F.when(F.startswith("field", F.lit('"')), F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(F.col("field"))
    cells = fields.select("doc_id", "doc_name", "row_idx", (F.col("c") + 1).alias("col_idx"), raw.alias("raw"))
    if max_rows is not None:
        cells = cells.where(F.col("row_idx") <= max_rows)
    if max_columns is not None:
        cells = cells.where(F.col("col_idx") <= max_columns)
    stem = F.coalesce(F.nullif(F.regexp_replace("doc_name", r"\.[^.]*$", ""), F.lit("")), F.lit("CSV"))
    value = S.blank_to_null("raw")
    good = cells.select(
        "doc_id", "doc_name", stem.alias("sheet"), "row_idx", "col_idx", value.alias("value_str"), S.parse_numeric("raw").alias("value_num"),
        F.when(value.isNotNull(), F.lit("text")).alias("value_kind"), F.lit(None).cast("string").alias("error"),
    )
    bad = texts.where("error IS NOT NULL").select("doc_id", "doc_name", stem.alias("sheet"), "error")
    return good.unionByName(bad, allowMissingColumns=True)
