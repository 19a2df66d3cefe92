"""Run one registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else repr(x)
    return repr(x)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spark_time = time.time() - t
    if sql is None:
        return None, len(got[1]), spark_time, 0.0
    t = time.time()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = _rows(cols, cur.fetchall())
    sql_time = time.time() - t
    if got == want:
        return "", len(got[1]), spark_time, sql_time
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}", len(got[1]), spark_time, sql_time
    a, b = set(got[1]), set(want[1])
    return f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}", len(got[1]), spark_time, sql_time


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from tests.session import session

    spark, con = session(), connect(SF_DIR)
    want = sys.argv[1:]
    bad = 0
    for name, fn in queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        try:
            diff, n, a, b = compare(spark, con, name, fn, oracle_sql().get(name), SF_DIR)
        except Exception as e:  # noqa: BLE001
            diff, n, a, b = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0, 0
        state = "no sql" if diff is None else "ok" if not diff else "BAD"
        bad += state == "BAD"
        print(f"{state:7}{name:34}{n:9}{a:8.2f}{b:8.2f} {diff or ''}", flush=True)
    print("bad:", bad)
