"""Run registered Spark queries and their DuckDB oracles side by side and compare.

Usage: python tools/check_oracles.py [sf_dir] [name-substring ...]

Comparison: same column-name set, same row count, and the same multiset of rows
after sorting columns by name (values compared exactly; floats by repr).
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from faultline.plans.catalog import ORACLES, QUERIES, load_all  # noqa: E402
from faultline.session import get_spark  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    load_all()
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    ok = bad = 0
    for name, fn in QUERIES.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = ORACLES.get(name)
        if sql is None:
            print(f"ROWS {name}: {len(srows)} rows, no oracle ({ts:.1f}s)")
            ok += 1
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns differ spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        a, b = canon(scols, srows), canon(dcols, drows)
        if len(a) != len(b):
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)}")
            bad += 1
            continue
        if a != b:
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: values differ ({len(a)} rows); cols={sorted(scols)}")
            for x, y in diffs:
                print("   spark:", x)
                print("   duck :", y)
            bad += 1
            continue
        print(f"OK   {name}: {len(a)} rows ({ts:.1f}s)")
        ok += 1
    print(f"\n{ok} ok, {bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
