"""Run registered queries on both engines and compare their rows.

    python -m tests.compare [sf] [key ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb

from exposight.verification.views import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (float, Decimal)):
        return repr(float(v))
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return len(ours[1]) > 0, f"rows {len(ours[1])} spark {t1 - t0:.1f}s (rows only)"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = normal(names, cur.fetchall())
    t2 = time.time()
    note = f"rows {len(ours[1])}/{len(theirs[1])} spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if ours == theirs:
        return True, note
    if ours[0] != theirs[0]:
        return False, f"{note} columns {ours[0]} / {theirs[0]}"
    a, b = set(ours[1]), set(theirs[1])
    return False, f"{note} only spark {sorted(a - b)[:2]!r:.600} only duckdb {sorted(b - a)[:2]!r:.600}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from exposight.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args[1:] or queries:
        try:
            ok, note = compare(spark, con, sf_dir, queries[key], oracles.get(key))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "BAD ", key, note, flush=True)
    print("failures:", bad)
