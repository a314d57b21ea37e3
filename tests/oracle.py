"""Queries held against their SQL in DuckDB."""

from pathlib import Path

import duckdb


def connected(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows(found, columns: list[str]) -> list[str]:
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in found)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    mine = rows((tuple(r) for r in df.select(*columns).collect()), columns)
    assert mine == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), columns)
