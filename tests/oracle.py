"""Holds registered queries against their DuckDB equivalents: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter
from decimal import Decimal


def plain(x):
    if x is None or isinstance(x, (bool, str, int)):
        return int(x) if isinstance(x, bool) else x
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return None if math.isnan(x) else (round(x, 6) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    got_cols = sorted(df.columns)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if got_cols != sorted(cols):
        return f"columns {got_cols} and {sorted(cols)}"
    want = Counter(tuple(plain(r[cols.index(c)]) for c in got_cols) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in got_cols) for r in df.collect())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
