"""Command line: python -m hydrolens {list,query,enrich,train} ...

  list                                   registered query names
  query NAME [--sf-dir D] [--show N] [--out PATH --format parquet|csv]
  enrich [--sf-dir D] [--source events|lineitem] --out PATH
  train  [--sf-dir D] --out PATH         fit RF + GBT, save models and metrics
  dashboard [--sf-dir D] --out PATH [--risks ...] [--severities ...] [--hours LO HI]
            [--min-spike X] [--households ...] [--search REGEX]   every page's tables
"""
from __future__ import annotations

import argparse
import os
import sys

DEFAULT_SF = "/root/testdata/sf0.01"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="hydrolens")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--sf-dir", default=DEFAULT_SF)
    q.add_argument("--show", type=int, default=20)
    q.add_argument("--out")
    q.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    e = sub.add_parser("enrich")
    e.add_argument("--sf-dir", default=DEFAULT_SF)
    e.add_argument("--source", choices=["events", "lineitem"], default="events")
    e.add_argument("--out", required=True)
    t = sub.add_parser("train")
    t.add_argument("--sf-dir", default=DEFAULT_SF)
    t.add_argument("--out", required=True)
    b = sub.add_parser("dashboard")
    b.add_argument("--sf-dir", default=DEFAULT_SF)
    b.add_argument("--source", choices=["events", "lineitem"], default="events")
    b.add_argument("--out", required=True)
    b.add_argument("--risks", nargs="*")
    b.add_argument("--severities", nargs="*")
    b.add_argument("--hours", nargs=2, type=int, default=[0, 23])
    b.add_argument("--min-spike", type=float, default=0.0)
    b.add_argument("--households", nargs="*", default=[])
    b.add_argument("--search", default="")
    a = p.parse_args(argv)

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from hydrolens.plans.catalog import QUERIES
    if a.cmd == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if spark is None:
        from hydrolens.session import local_session
        spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.cmd == "query":
        if a.name not in QUERIES:
            print(f"unknown query {a.name!r}; see `python -m hydrolens list`", file=sys.stderr)
            return 2
        df = QUERIES[a.name](spark, a.sf_dir)
        if a.out:
            w = df.write.mode("overwrite")
            (w.option("header", True).csv(a.out) if a.format == "csv" else w.parquet(a.out))
        else:
            df.show(a.show, truncate=False)
    elif a.cmd == "enrich":
        from hydrolens.plans.jobs import enrich_job
        enrich_job(spark, a.sf_dir, a.out, a.source)
    elif a.cmd == "dashboard":
        from hydrolens.plans.jobs import dashboard_job
        names = dashboard_job(spark, a.sf_dir, a.out, a.source, a.search, risks=a.risks, severities=a.severities,
                              hours=tuple(a.hours), min_spike=a.min_spike, households=a.households)
        print("\n".join(names))
    elif a.cmd == "train":
        from hydrolens.plans.jobs import train_job
        train_job(spark, a.sf_dir, a.out).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
