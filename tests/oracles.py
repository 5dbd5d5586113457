"""Comparison of a Spark result with DuckDB's for the same query."""

from __future__ import annotations

import math


def _cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_cell(y) for y in x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (int, str, bool)):
        return x
    return str(x) if not hasattr(x, "__float__") else round(float(x), 6)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, got.fetchall())
    have = rows_of(df.columns, df.collect())
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a == b
