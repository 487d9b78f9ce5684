"""Run a registered Spark query and its DuckDB oracle; compare rows, columns and values.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""
from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def canon(v):
    if v is None:
        return "∅"
    try:
        import pandas as pd
        if v is pd.NaT or v is pd.NA:
            return "∅"
    except Exception:  # noqa: BLE001
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return canon(v.item())
        except Exception:  # noqa: BLE001
            pass
    if isinstance(v, (dt.datetime, dt.date)) or type(v).__name__ in ("Timestamp", "datetime64"):
        import pandas as pd
        return str(pd.Timestamp(v))
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(canon(x) for x in rec) for rec in pdf[cols].itertuples(index=False, name=None))


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name: str, sf_dir: str, verbose: bool = True) -> bool:
    import __spark_entry__ as se
    q = se.queries()[name]
    sql = se.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        print(f"{name:32s} rows-only  spark={len(sdf)} ({t1 - t0:.1f}s)")
        return True
    ddf = con.execute(sql).df()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    ok = sc == dc and len(sr) == len(dr) and sr == dr
    status = "OK " if ok else "BAD"
    print(f"{name:32s} {status} spark={len(sr)} duck={len(dr)} ({t1 - t0:.1f}s)")
    if not ok and verbose:
        if sc != dc:
            print("   cols spark:", sc, "\n   cols duck: ", dc)
        else:
            a, b = set(sr), set(dr)
            for x in list(a - b)[:3]:
                print("   spark only:", x)
            for x in list(b - a)[:3]:
                print("   duck only: ", x)
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from hydrolens.session import local_session
    import __spark_entry__ as se
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = names or list(se.queries())
    bad = []
    for n in names:
        try:
            if not compare(spark, con, n, sf_dir):
                bad.append(n)
        except Exception as e:  # noqa: BLE001
            print(f"{n:32s} ERR {type(e).__name__}: {str(e)[:400]}")
            bad.append(n)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
