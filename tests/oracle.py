"""Compares a query with its DuckDB statement as the driver does: rows, columns, values in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def differences(spark, folder: str, query, sql: str) -> str:
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    con = connection(folder).execute(sql)
    there = [d[0] for d in con.description]
    if sorted(there) != names:
        return f"columns {names} against {sorted(there)}"
    at = [there.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in con.fetchall()), key=repr)
    if got == want:
        return ""
    extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{names}: {len(got)} rows against {len(want)}; only here {extra}; only there {missing}"
