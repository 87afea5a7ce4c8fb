"""Compare a Spark result with its SQL counterpart on the same parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from gleanery.plans.registry import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    other = {d[0]: str(d[1]) for d in cur.description}
    left = [tuple(norm(r[c]) for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect()]
    idx = [names.index(c) for c in order]
    right = [tuple(norm(r[i]) for i in idx) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, type(x).__name__, str(x)) for x in r)
    left.sort(key=key)
    right.sort(key=key)
    if left != right:
        in_left, in_right = set(left), set(right)
        extra = [r for r in left if r not in in_right][:2]
        lacking = [r for r in right if r not in in_left][:2]
        return f"rows {len(left)} vs {len(right)}; {order}\n  only spark {extra}\n  only sql {lacking}"
    if not left:
        return "EMPTY"
    odd = [(c, kinds[c], other[c]) for c in order
           if (kinds[c] == "bigint" and other[c] in ("HUGEINT", "DOUBLE")) or kinds[c].startswith("decimal") or other[c] == "HUGEINT"]
    return f"TYPES {odd}" if odd else None
