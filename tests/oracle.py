"""Compare a query with its SQL in DuckDB on the same files."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _key(row):
    return tuple((x is None, f"{x:.6f}" if isinstance(x, float) else str(x)) for x in row)


def assert_same(df, sql: str, sf_dir: str) -> None:
    result = connection(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(_key(r[names.index(c)] for c in order) for r in result.fetchall())
    got = sorted(_key(r) for r in df.select(*order).collect())
    assert got == want
