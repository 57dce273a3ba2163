"""Runs a query and its SQL over the same folder and compares their rows."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(names: list[str], values) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


def assert_same(spark, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    con = connection(folder)
    con.execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, con.fetchall())
