"""Run registered queries on Spark and their SQL on DuckDB; compare results.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, schema and value agreement.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from stratocast.plans import catalog  # noqa: E402
from stratocast.session import build_session  # noqa: E402
from stratocast.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows_of(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        out.append(tuple(canon(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    catalog.load_all()
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            pdf = pd.DataFrame([r.asDict(recursive=True) for r in sdf.collect()], columns=sdf.columns)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        dt = time.time() - t0
        sql = catalog.SQL.get(name)
        if sql is None:
            print(f"ROWS {name}: {len(pdf)} rows ({dt:.1f}s) no oracle")
            continue
        try:
            odf = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            continue
        sc, sr = rows_of(pdf)
        oc, orows = rows_of(odf)
        if sc != oc:
            bad += 1
            print(f"FAIL {name}: columns spark={sc} oracle={oc}")
            continue
        if len(sr) != len(orows):
            bad += 1
            print(f"FAIL {name}: rows spark={len(sr)} oracle={len(orows)}")
            continue
        diff = [(a, b) for a, b in zip(sr, orows) if a != b]
        if diff:
            bad += 1
            print(f"FAIL {name}: {len(diff)} differing rows, e.g.\n  spark ={diff[0][0]}\n  oracle={diff[0][1]}")
            continue
        print(f"OK   {name}: {len(sr)} rows ({dt:.1f}s)")
    print(f"-- {bad} failing")


if __name__ == "__main__":
    main()
