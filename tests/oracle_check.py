"""Compare registered queries with their SQL: ``python tests/oracle_check.py <sf_dir> [names…]``."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return "\0"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    frame = contract.queries()[name](spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    spark_seconds = time.time() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL ({spark_seconds:.1f}s)"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    note = f"{len(got)} rows (spark {spark_seconds:.1f}s, sql {time.time() - start:.1f}s)"
    if sorted(names) != sorted(frame.columns):
        return False, f"columns differ: {sorted(frame.columns)} / {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"{note} expected {len(want)}; only spark {sorted(a - b)[:3]} ({len(a - b)}); only sql {sorted(b - a)[:3]} ({len(b - a)})"
    return True, note


if __name__ == "__main__":
    from tidemark.session import local_session

    session = local_session(8)
    directory = sys.argv[1]
    connection = connect(directory)
    bad = []
    for query in sys.argv[2:] or contract.queries():
        try:
            ok, message = compare(session, connection, query, directory)
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += [] if ok else [query]
        print("ok  " if ok else "BAD ", query, message, flush=True)
    print("failed:", bad)
