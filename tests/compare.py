"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if hasattr(v, "as_tuple"):
        return "decimal " + str(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(plain(r[i]) for i in order) for r in rows)


def connect(sf: str):
    import duckdb

    from photocat.plans.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf: str, name: str, fn, sql: str | None):
    """(rows, problem or None)"""
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(want_cols, want)
    if gc != wc:
        return len(got), f"columns {gc} / {wc}"
    if g != w:
        gs, ws = set(g), set(w)
        only_g, only_w = sorted(gs - ws)[:2], sorted(ws - gs)[:2]
        return len(got), f"{len(g)}/{len(w)} rows, {len(gs - ws)} differ\n   spark  {only_g}\n   duckdb {only_w}\n   {gc}"
    return len(got), None


def main():
    import __spark_entry__ as entry

    from photocat.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark, con = local_session("compare"), connect(a.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, a.sf, name, fn, oracle.get(name))
        except Exception as e:  # shown, and the next query runs
            n, problem = -1, f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name:34} {n:8d} rows {time.time() - t:6.2f}s"
              f"{'' if name in oracle else ' (rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
