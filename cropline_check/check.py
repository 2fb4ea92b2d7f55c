"""Run the registered queries next to their DuckDB statements: ``python -m cropline_check.check [sf_dir] [key ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from cropline.session import build_session
from cropline_check.oracle import oracle_statements
from cropline_check.queries import QUERIES

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, key: str, sql: str) -> str | None:
    """None if both engines give the same rows, else the first difference."""
    df = QUERIES[key](spark, sf_dir)
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = _sorted(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"{sorted(columns)}\n    spark {a}\n    duck  {b}"
    return None if got else "no rows"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, statements, bad = connect(sf_dir), oracle_statements(), 0
    for key in keys:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, key, statements[key])
        except Exception as e:  # report every key, then fail
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {key} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
