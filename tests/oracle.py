"""Comparison of a Spark result with DuckDB's."""

import math
from pathlib import Path

import duckdb


def connect(data: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(data).iterdir():
        src = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM read_parquet('{src}')")
    return con


def _value(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        x = float(x)
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_value, x)) + "]"
    return "null" if x is None else str(float(x)) if isinstance(x, int) else str(x)


def canonical(rows, columns) -> list[str]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted("|".join(_value(r[k]) for k in order) for r in rows)


def same(df, con, sql: str) -> None:
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), columns)
