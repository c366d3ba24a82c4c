"""Run a query and its SQL over the same tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def data_dir(sf: str) -> str:
    return os.environ.get("TEST_DATA", "/root/testdata") + f"/{sf}"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        if path.exists():
            con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _value(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return round(float(v), 9)
    return v


def compare(spark, query, sql: str, folder: str) -> tuple[list, list]:
    """(rows of Spark, rows of DuckDB), both sorted, columns by name."""
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted((tuple(_value(r[n]) for n in names) for r in df.select(*names).collect()), key=repr)
    found = connect(folder).execute(sql)
    cols = [d[0] for d in found.description]
    assert sorted(cols) == names, (sorted(cols), names)
    order = [cols.index(n) for n in names]
    theirs = sorted((tuple(_value(r[i]) for i in order) for r in found.fetchall()), key=repr)
    return ours, theirs
