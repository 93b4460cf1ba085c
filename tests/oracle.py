"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0 if abs(value) < 1e15 else value
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def differences(df, sql: str, con) -> list[str]:
    """What differs, in words; none if the query agrees with the SQL."""
    out = []
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name].replace("[]", "") and not (kind.startswith("array") and kinds[name].endswith("]")):
            out.append(f"{name}: {kind} and {kinds[name]}")
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    want = [tuple(plain(r[i]) for i in at) for r in want]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    if len(got) != len(want):
        out.append(f"{len(got)} and {len(want)} rows")
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        out.append(f"{len(bad)} rows differ, first {bad[:2]}")
    return out
