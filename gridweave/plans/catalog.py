"""A dictionary of queries: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a query under its function name."""

        def register(query: Query) -> Query:
            name = query.__name__
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register

    def describe(self) -> list[tuple[str, str]]:
        return [(name, (query.__doc__ or "").strip().split("\n")[0]) for name, query in self.queries.items()]


def table(spark: SparkSession, folder: str, name: str, spread: str | None = None) -> DataFrame:
    """A table of the folder; with `spread` its rows are dealt by that column, as one row group may hold all of them.

    The number of parts is given: parts of few bytes may be much work, and without a number they would be put
    together by their bytes, so that few cores do it.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if spread is None:
        return df
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, spread)
