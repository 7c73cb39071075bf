"""Run registered queries and write their results (nothing is collected to the driver).

    python -m pursewise list
    python -m pursewise run spending_series_week --tables /data/sf1 --out /shared/out [--format json]
    python -m pursewise explain spending_series_week --tables /data/sf1
"""

from __future__ import annotations

import argparse
import sys

from pursewise.registry import ORACLES, QUERIES


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="pursewise")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query", choices=sorted(QUERIES))
        p.add_argument("--tables", required=True, help="folder with the <table>.parquet inputs")
        if name == "run":
            p.add_argument("--out", required=True)
            p.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    args = ap.parse_args(argv)
    if args.cmd == "list":
        for n in sorted(QUERIES):
            print(f"{n}\t{'oracle' if n in ORACLES else 'rows'}")
        return 0

    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.appName(f"pursewise-{args.query}")
             .config("spark.ui.enabled", "false").getOrCreate())
    df = QUERIES[args.query](spark, args.tables)
    if args.cmd == "explain":
        df.explain("formatted")
        return 0
    w = df.write.mode("overwrite")
    if args.format == "csv":
        w = w.option("header", "true")
    getattr(w, args.format)(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
