"""Runs a query and its SQL on the same tables and compares names, row counts and values, as sorted rows."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(d: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float | Decimal):
        x = float(x)
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, con, d: str, f, sql: str) -> str:
    """Empty if both agree, else what differs first."""
    df = f(spark, d)
    names, mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    other_names, other = rows_of([c[0] for c in cur.description], cur.fetchall())
    if names != other_names:
        return f"columns {names} and {other_names}"
    if len(mine) != len(other):
        return f"{len(mine)} and {len(other)} rows; {next((a for a, b in zip(mine, other) if a != b), None)} and {next((b for a, b in zip(mine, other) if a != b), None)}"
    for a, b in zip(mine, other, strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""
