import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def grid(spark):
    """Cells of one sheet from a list of rows."""
    from pyspark.sql import functions as F

    from gridweave.functions import scalars as S

    def build(rows, doc_id="d1", sheet="Sheet1", doc_name="book.xlsx"):
        flat = [
            (doc_id, doc_name, sheet, r, c, None if v is None else str(v))
            for r, row in enumerate(rows, start=1) for c, v in enumerate(row, start=1)
        ]
        df = spark.createDataFrame(flat, "doc_id string, doc_name string, sheet string, row_idx int, col_idx int, raw string")
        return df.select("doc_id", "doc_name", "sheet", "row_idx", "col_idx", S.blank_to_null("raw").alias("value_str"), S.parse_numeric("raw").alias("value_num")).where(
            F.col("value_str").isNotNull()
        )

    return build
