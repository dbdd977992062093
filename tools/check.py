"""Run named queries on Spark and their SQL on DuckDB over the same tables, and compare.

usage: python tools/check.py SF_DIR [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (f"{x:.6g}")
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.6g}" if abs(x) < 1e6 else str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(norm(y) for y in x) + "]"
    return str(x)


def main() -> int:
    from scanlake.queries import ORACLES, QUERIES
    from scanlake.session import local_session
    sf, parts = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            rows = df.collect()
        except Exception as e:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}")
            continue
        dt = time.time() - t0
        if name not in ORACLES:
            print(f"rows {name}: {len(rows)} rows {dt:.2f}s {df.dtypes}")
            continue
        try:
            rel = con.sql(ORACLES[name])
            cols, want = rel.columns, rel.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQL  {name}: {str(e)[:1500]}")
            continue
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"COLS {name}: {sorted(df.columns)} vs {sorted(cols)}")
            continue
        order = sorted(cols)
        got = sorted(tuple(norm(r[c]) for c in order) for r in rows)
        idx = [cols.index(c) for c in order]
        exp = sorted(tuple(norm(r[i]) for i in idx) for r in want)
        if got != exp:
            bad += 1
            a, b = set(got) - set(exp), set(exp) - set(got)
            print(f"DIFF {name}: spark {len(got)} sql {len(exp)} {order}\n   only spark {list(a)[:2]}\n   only sql   {list(b)[:2]}")
        else:
            print(f"ok   {name}: {len(got)} rows {dt:.2f}s")
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
