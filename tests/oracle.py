"""Comparison of a DataFrame with the same query in DuckDB."""

import math
from pathlib import Path

import duckdb

_CONNECTIONS = {}


def connect(sf_dir):
    if sf_dir not in _CONNECTIONS:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for path in Path(sf_dir).glob("*.parquet"):
            source = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
        _CONNECTIONS[sf_dir] = con
    return _CONNECTIONS[sf_dir]


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "toArray"):
        return tuple(plain(float(y)) for y in x.toArray())
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((x is not None, str(x)) for x in r))


def same(df, sql, sf_dir):
    cursor = connect(sf_dir).execute(sql)
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    got, want = rows(df.collect(), df.columns), rows(expected, columns)
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
    return len(got)
