"""Grids as cells: typing of values, wide tables to cells and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions import scalars as S


def typed_cell(value: Column, data_type: T.DataType) -> Column:
    """Cell struct (value_str, value_num, value_kind) of a value of any scalar type.

    Blank text is no value, booleans are never numbers, dates and times become ISO text.
    """
    if isinstance(data_type, T.BooleanType):
        text, number, kind = F.initcap(value.cast("string")), F.lit(None).cast("double"), "bool"
    elif isinstance(data_type, T.NumericType):
        text, number, kind = value.cast("string"), value.cast("double"), "number"
    elif isinstance(data_type, T.DateType):
        text, number, kind = F.date_format(value, "yyyy-MM-dd"), F.lit(None).cast("double"), "date"
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        text, number, kind = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(None).cast("double"), "date"
    else:
        text, number, kind = S.blank_to_null(value.cast("string")), S.parse_numeric(value.cast("string")), "text"
    return F.struct(
        text.alias("value_str"), number.alias("value_num"), F.when(text.isNotNull(), F.lit(kind)).alias("value_kind")
    )


def to_cells(
    df: DataFrame,
    doc_id: Column,
    sheet: Column,
    row_idx: Column,
    columns: Sequence[str],
    doc_name: Column | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """A wide table as cells, one row per filled cell; `row_idx` is the row of each record in its sheet."""
    types = {f.name: f.dataType for f in df.schema.fields}
    items = F.array(
        *[
            F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("header"), typed_cell(F.col(c), types[c]).alias("v"))
            for i, c in enumerate(columns, start=1)
        ]
    )
    cells = df.select(
        doc_id.cast("string").alias("doc_id"),
        (doc_name if doc_name is not None else doc_id).cast("string").alias("doc_name"),
        sheet.cast("string").alias("sheet"),
        row_idx.alias("row_idx"),
        F.explode(items).alias("c"),
    ).select("doc_id", "doc_name", "sheet", "row_idx", "c.col_idx", "c.header", "c.v.*")
    return cells if keep_empty else cells.where("value_str IS NOT NULL")


def header_cells(sheets: DataFrame, columns: Sequence[str], row_idx: Column | int = 1) -> DataFrame:
    """The header cells of the sheets (doc_id, doc_name, sheet), to go with `to_cells`."""
    row = F.lit(row_idx) if isinstance(row_idx, int) else row_idx
    names = F.array(
        *[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("header")) for i, c in enumerate(columns, start=1)]
    )
    return sheets.select("doc_id", "doc_name", "sheet", row.alias("row_idx"), F.explode(names).alias("h")).select(
        "doc_id", "doc_name", "sheet", "row_idx", "h.col_idx", "h.header", F.col("h.header").alias("value_str"),
        F.lit(None).cast("double").alias("value_num"), F.lit("text").alias("value_kind"),
    )


def to_wide(cells: DataFrame, keys: Sequence[str], headers: Sequence[str]) -> DataFrame:
    """Cells of sheets with one known schema as a wide table: one aggregation by row."""
    picks = [F.max(F.when(F.col("header") == h, F.col("value_str"))).alias(h) for h in headers]
    return cells.groupBy(*keys, "row_idx").agg(*picks)
