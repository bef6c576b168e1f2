"""Compare a query with its DuckDB text: same columns, same multiset of values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if hasattr(v, "as_tuple"):
        return _norm(float(v))
    return v


def compare(df, con, sql: str):
    """Returns ``(ok, message)``."""
    cols = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in at) for r in cur.fetchall()]
    if Counter(got) == Counter(want):
        return True, f"{len(got)} rows"
    only_got = list((Counter(got) - Counter(want)).elements())
    only_want = list((Counter(want) - Counter(got)).elements())
    return False, (f"{len(got)} vs {len(want)} rows {cols}\n   spark  {only_got[:3]}\n   duckdb {only_want[:3]}"
                   f"\n   ({len(only_got)} / {len(only_want)} differ)")
