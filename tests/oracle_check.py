"""Compare registered queries with their SQL, row by row.

    python tests/oracle_check.py sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns), key=repr) if columns else []


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{sf}/{name}.parquet')"
        )
    return con


def difference(spark, con, sf: str, name: str) -> str | None:
    """None when equal, else a short description."""
    from placewright.catalog.oracle import ORACLE_SQL
    from placewright.catalog.queries import QUERIES

    got_names, got = rows_of(QUERIES[name](spark, f"{DATA}/{sf}").toArrow())
    want_names, want = rows_of(con.execute(ORACLE_SQL[name]).to_arrow_table())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return (
            f"{len(got)} rows vs {len(want)}\n   spark {str(only_got)[:900]}"
            f"\n   sql   {str(only_want)[:900]}"
        )
    return None


def main() -> int:
    from placewright.catalog.oracle import ORACLE_SQL
    from placewright.session import build_session

    spark = build_session(
        master="local[8]",
        conf={
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    names = sys.argv[2:] or list(ORACLE_SQL)
    con, bad = duck(sf), 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, sf, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.1f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{len(names)} checked, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
