"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math

# Spark type to DuckDB types that hold the same values.
SAME = {
    "string": {"VARCHAR"}, "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"},
    "date": {"DATE"}, "boolean": {"BOOLEAN"},
}


def spark_rows(df):
    names = sorted(df.columns)
    types = {n: t for n, t in df.dtypes}
    rows = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, [types[n] for n in names], rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    names = [rel.columns[i] for i in order]
    types = [str(rel.types[i]) for i in order]
    return names, types, [tuple(r[i] for i in order) for r in rel.fetchall()]


def _key(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return repr(v)


def differences(ours, theirs) -> str | None:
    """What differs, or None."""
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    types = [f"{n}:{a}/{b}" for n, a, b in zip(ours[0], ours[1], theirs[1]) if b not in SAME.get(a, {a})]
    if len(ours[2]) != len(theirs[2]):
        return f"rows {len(ours[2])} / {len(theirs[2])}"
    a = sorted(tuple(_key(v) for v in r) for r in ours[2])
    b = sorted(tuple(_key(v) for v in r) for r in theirs[2])
    off = [(x, y) for x, y in zip(a, b) if x != y]
    if off:
        x, y = off[0]
        cells = [(n, p, q) for n, p, q in zip(ours[0], x, y) if p != q]
        return f"values in {len(off)} rows, first {cells[:4]} {types}"
    if not ours[2]:
        return None if not types else f"empty, types {types}"
    return f"types {types}" if types else None
