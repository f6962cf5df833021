"""Run registered Spark queries and their DuckDB oracles side by side and compare.

    python scripts/oracle_check.py [--sf /root/testdata/sf0.01] [name-substring ...]

Compares row count, column names and the multiset of rows (floats with a small relative
tolerance).  Prints one line per query and a JSON summary at the end.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

from feedlake.plans.registry import all_queries  # noqa: E402
from feedlake.session import local_session  # noqa: E402
from feedlake.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.floating,)):
        v = float(v)
    if isinstance(v, (np.integer,)):
        v = int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and v == int(v) and abs(v) < 2**53:
        return float(v)
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    out = []
    for v in row:
        if isinstance(v, float):
            out.append((1, round(v, 5), ""))
        elif v is None:
            out.append((0, 0, ""))
        elif isinstance(v, (int,)):
            out.append((1, float(v), ""))
        else:
            out.append((2, 0, str(v)))
    return out


def _close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        try:
            return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-6)
        except TypeError:
            return False
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return a == b


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    rows.sort(key=_key)
    return [columns[i] for i in order], rows


def compare(spark_cols, spark_rows, duck_cols, duck_rows):
    sc, sr = rows_of(spark_cols, spark_rows)
    dc, dr = rows_of(duck_cols, duck_rows)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count spark={len(sr)} duck={len(dr)}"
    for i, (a, b) in enumerate(zip(sr, dr)):
        if not all(_close(x, y) for x, y in zip(a, b)):
            return False, f"row {i} differs:\n  spark={a}\n  duck ={b}"
    return True, f"{len(sr)} rows"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{args.sf}/{t}.parquet')")
    summary = {}
    for name, q in sorted(all_queries().items()):
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            sdf = q.fn(spark, args.sf)
            srecs = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # report and continue
            summary[name] = "spark-error"
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:800]}")
            continue
        ts = time.time() - t0
        if q.oracle is None:
            summary[name] = f"rows-only:{len(srecs)}"
            print(f"ROWS {name}: {len(srecs)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(q.oracle)
            dcols = [d[0] for d in res.description]
            drecs = res.fetchall()
        except Exception as e:
            summary[name] = "oracle-error"
            print(f"FAIL {name}: oracle error {type(e).__name__}: {str(e)[:800]}")
            continue
        ok, msg = compare(scols, srecs, dcols, drecs)
        summary[name] = "ok" if ok else "mismatch"
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} ({ts:.1f}s)")
    print(json.dumps(summary))
    spark.stop()


if __name__ == "__main__":
    main()
