"""Run queries and their oracle side by side and compare values."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from reviewlake.sources.corpus import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in entry.oracle_sql():
        return None if got else "no rows"
    rel = con.sql(entry.oracle_sql()[name])
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return None if got else "no rows"
    only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"{len(got)} vs {len(want)} rows; spark {only_got[:2]} oracle {only_want[:2]}"


if __name__ == "__main__":
    from reviewlake.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    session, con = local_session(), connect(sf)
    for name in names:
        start = time.time()
        try:
            problem = compare(session, con, name, sf)
        except Exception as error:  # report and go on with the next query
            problem = "ERROR " + str(error)[:700]
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
