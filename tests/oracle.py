"""Compares registered queries with their SQL statement on the same tables.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return (2, "nan")
        return (2, repr(round(value, 6) + 0.0))
    if isinstance(value, int):
        return (2, repr(float(value)) if abs(value) < 2**53 else str(value))
    return (3, str(value))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    columns, rows = normalise(df.columns, [tuple(r) for r in got])
    if sql is None:
        return None if rows else "no rows", len(rows), took
    cursor = con.execute(sql)
    expected = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    want_columns, want = normalise(names, expected)
    if columns != want_columns:
        return f"columns {columns} != {want_columns}", len(rows), took
    if rows != want:
        extra = [r for r in rows if r not in set(want)][:2]
        lost = [r for r in want if r not in set(rows)][:2]
        return f"rows {len(rows)} vs {len(want)}; extra {extra}; missing {lost}", len(rows), took
    return None, len(rows), took


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from sonaria.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    statements = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        try:
            problem, count, took = compare(spark, con, name, fn, statements.get(name), sf_dir)
        except Exception as error:
            problem, count, took = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "sql " if name in statements else "rows"
        print(f"{mark} {kind} {name:32s} {count:7d} rows {took:6.2f}s {problem or ''}", flush=True)
    spark.stop()
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
