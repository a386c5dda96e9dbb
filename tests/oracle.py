"""Compare a query with its SQL in DuckDB on the same Parquet files."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if pathlib.Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, "nan" if isinstance(v, float) and math.isnan(v) else float(v))
    return (3, str(v))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: [_key(v) for v in r]
    )


def differences(df, con, sql: str, show: int = 3) -> list[str]:
    """Empty when columns, types of values and all rows agree exactly."""
    sc, sr = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = _rows([c[0] for c in cur.description], cur.fetchall())
    if sc != dc:
        return [f"columns {sc} != {dc}"]
    if len(sr) != len(dr):
        only_s = [r for r in sr if r not in set(dr)][:show]
        only_d = [r for r in dr if r not in set(sr)][:show]
        return [f"rows {len(sr)} != {len(dr)}", f"spark only {only_s}", f"sql only {only_d}"]
    out = []
    for a, b in zip(sr, dr):
        if any(type(x) is not type(y) and x is not None and y is not None for x, y in zip(a, b)):
            out.append(f"types {a} / {b}")
        elif a != b:
            out.append(f"{a} != {b}")
        if len(out) >= show:
            break
    return out
