"""Local stand-in for the correctness gate: run registered queries on Spark
and their oracle SQL on DuckDB over the same parquet files, compare row count,
column names and the multiset of rows.

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from refract.plans import catalog  # noqa: E402
from refract.session import local_session  # noqa: E402
from refract.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    catalog.load_all()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            rows = [tuple(norm(x) for x in r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = catalog.ORACLE.get(name)
        if sql is None:
            print(f"ROWS-ONLY {name}: {len(rows)} rows  spark {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            cur = con.execute(sql)
            ocols = [d[0] for d in cur.description]
            orows = [tuple(norm(x) for x in r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:600]}")
            bad += 1
            continue
        to = time.time() - t1
        if sorted(cols) != sorted(ocols):
            print(f"MISMATCH-COLS {name}: spark={cols} sql={ocols}")
            bad += 1
            continue
        idx = [ocols.index(c) for c in cols]
        orows = [tuple(r[i] for i in idx) for r in orows]
        ca, cb = Counter(rows), Counter(orows)
        if ca == cb:
            print(f"OK {name}: {len(rows)} rows  spark {ts:.1f}s  duckdb {to:.1f}s")
        else:
            bad += 1
            only_s = list((ca - cb).elements())[:3]
            only_o = list((cb - ca).elements())[:3]
            print(f"MISMATCH {name}: spark {len(rows)} sql {len(orows)} rows; "
                  f"spark-only {only_s}; sql-only {only_o}")
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
