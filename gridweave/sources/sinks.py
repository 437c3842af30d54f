"""Sinks: result tables, Markdown, manifests of written content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.rules import fixed

RESULT_COLUMNS = list(fixed.RESULT_HEADERS)


def present_columns(rows: DataFrame) -> list[str]:
    """Result columns with at least one value, in sheet order. Reads one row of flags."""
    flags = rows.agg(
        *[F.max((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int")).alias(c) for c in RESULT_COLUMNS]
    ).first()
    return [c for c in RESULT_COLUMNS if flags[c]]


def write_result_table(rows: DataFrame, path: str, file_format: str = "parquet", local_headers: bool = True) -> list[str]:
    """Write the present columns of the result rows; returns the headers."""
    columns = present_columns(rows)
    names = [fixed.RESULT_HEADERS[c] if local_headers else c for c in columns]
    table = rows.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    writer = table.write.mode("overwrite")
    (writer.option("header", "true") if file_format == "csv" else writer).format(file_format).save(path)
    return names


def markdown_row(columns: Sequence[Column]) -> Column:
    """One Markdown table row; values are shown as they are."""
    shown = [F.coalesce(c.cast("string"), F.lit("None")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def markdown_table(rows: DataFrame, key: Sequence[str], order: Column, headers: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """One Markdown table per report key. A report is a document, so its rows fit into one row of text."""
    head = "| " + " | ".join(headers) + " |\n| " + " | ".join("---" for _ in headers) + " |"
    lines = rows.select(*key, F.struct(order.alias("o"), markdown_row(columns).alias("line")).alias("r"))
    return lines.groupBy(*key).agg(
        F.concat(
            F.lit(f"{fixed.MARKDOWN_TITLE}\n\n{head}\n"),
            F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n"),
        ).alias("markdown")
    )


def manifest(files: DataFrame, name: str, content: str, mime: str = "text/markdown; charset=utf-8") -> DataFrame:
    """Name, size, sha256 and MIME type of each produced content."""
    data = F.col(content)
    return files.select(
        F.col(name).alias("name"), F.octet_length(data).alias("size_bytes"), F.sha2(data.cast("binary"), 256).alias("sha256"),
        F.lit(mime).alias("mime_type"), S.document_type(name).alias("doc_type"),
    )
