"""Compare a query with its SQL run by DuckDB on the same tables, rows in any order."""

from __future__ import annotations

import os

import duckdb


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows_of(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, got = rows_of(df)
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
