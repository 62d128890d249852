"""Compare a Spark result with a DuckDB result, order aside."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(plain, key=repr)


def _key(rows):
    return [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows]


def differences(df, con, sql: str) -> list[str]:
    """Empty if both agree; otherwise a few lines on how they do not."""
    found = con.execute(sql)
    want_names, want = _rows([d[0] for d in found.description], found.fetchall())
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if names != want_names:
        return [f"columns {names} != {want_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    got, want = sorted(_key(got), key=repr), sorted(_key(want), key=repr)
    off = [(a, b) for a, b in zip(got, want) if a != b]
    return [f"{len(off)} of {len(got)} rows differ", *[f"{a} != {b}" for a, b in off[:3]]] if off else []
