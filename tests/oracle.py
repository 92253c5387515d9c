"""Runs a query and its DuckDB text and compares rows without order."""

import os

import duckdb

from tallyglass.sources.views import TABLES


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def text(x):
    if x is None:
        return "NULL"
    if isinstance(x, float) and not isinstance(x, bool):
        return f"{x:.6g}"
    return str(x)


def rows(found):
    return sorted(tuple(map(text, r)) for r in found)


def check(df, con, sql):
    cols = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = rows(con.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    got = rows(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want
