"""A query's rows against those of its SQL in DuckDB: counts, columns and values, in any order."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return float(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    try:
        return float(x) if type(x).__name__ == "Decimal" else str(x)
    except ValueError:
        return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got[0] == want[0], f"columns {got[0]} and {want[0]}"
    assert len(got[1]) == len(want[1]), f"{len(got[1])} rows and {len(want[1])}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not wrong, f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}"
    return len(got[1])
