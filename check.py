"""Compare the registered queries with their SQL: python check.py [names...] [--sf DIR]."""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from gridweave.plans import load
from gridweave.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def shown(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)


def normal(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    left = normal(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    right = normal(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if left == right:
        return True, f"{len(left)} rows"
    in_left, in_right = set(left), set(right)
    only_left = [r for r in left if r not in in_right][:2]
    only_right = [r for r in right if r not in in_left][:2]
    return False, f"{len(left)} / {len(right)} rows, spark only {only_left}, sql only {only_right}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    catalog = load()
    names = args.names or list(catalog.queries)
    spark, con = local_session(8), connect(args.sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in catalog.sql:
                good, text = compare(catalog.queries[name](spark, args.sf), con, catalog.sql[name])
            else:
                good, text = True, f"{len(catalog.queries[name](spark, args.sf).collect())} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - reported per query
            good, text = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:24s} {time.time() - start:6.2f}s  {text}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
