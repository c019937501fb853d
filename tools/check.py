"""Compare every registered query with its SQL: ``python tools/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docmill.session import local_session  # noqa: E402
from workload import ORACLES, QUERIES  # noqa: E402

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0null"
    if isinstance(value, float):
        return repr(float(value) + 0.0)
    return f"{type(value).__name__}:{value}"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    columns, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if rows else "no rows"
    cursor = con.execute(ORACLES[name])
    expected_columns, expected = normal([c[0] for c in cursor.description], cursor.fetchall())
    if columns != expected_columns:
        return f"columns {columns} / {expected_columns}"
    if not expected:
        return "the SQL gives no rows"
    if len(rows) != len(expected):
        return f"rows {len(rows)} / {len(expected)}"
    bad = [(a, b) for a, b in zip(rows, expected) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ, e.g.\n  {str(bad[0][0])[:700]}\n  {str(bad[0][1])[:700]}" if bad else None


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:34s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{failed} failed")
