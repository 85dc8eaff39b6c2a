"""Runs a registered query and its SQL on the same tables, and compares rows as bags."""

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, Decimal)) and v == int(v):
        return int(v)
    if isinstance(v, (float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def from_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    return bag([c[0] for c in found.description], found.fetchall())


def from_spark(frame):
    return bag(frame.columns, [tuple(r) for r in frame.collect()])
