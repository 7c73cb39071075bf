"""Side-by-side check of a registered query against its DuckDB oracle.

Compares row count, column names and the multiset of rows (order-insensitive), with
floats rounded to 6 decimals and dates as ISO text. Usable from pytest and as a script:

    python tests/harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from pursewise.registry import ORACLES, QUERIES

    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    cols = sdf.columns
    rows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "spark_rows": len(rows), "spark_sec": round(t_spark, 2)}
    if name not in ORACLES:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    rel = con.execute(ORACLES[name])
    ocols = [d[0] for d in rel.description]
    orows_raw = rel.fetchall()
    oidx = {c: i for i, c in enumerate(ocols)}
    out["oracle_rows"] = len(orows_raw)
    if sorted(ocols) != sorted(cols):
        out["status"] = f"columns differ: spark={sorted(cols)} oracle={sorted(ocols)}"
        return out
    orows = [tuple(_norm(r[oidx[c]]) for c in cols) for r in orows_raw]
    if Counter(rows) == Counter(orows):
        out["status"] = "match"
    else:
        a, b = Counter(rows), Counter(orows)
        only_s = list((a - b).elements())[:3]
        only_o = list((b - a).elements())[:3]
        out["status"] = f"values differ: spark-only={only_s} oracle-only={only_o}"
    return out


def main(argv):
    sys.path.insert(0, ".")
    from pursewise.registry import QUERIES
    from pursewise.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(QUERIES)
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as err:  # report and continue with the next query
            r = {"name": n, "status": f"error: {type(err).__name__}: {str(err)[:300]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:45s} {r.get('spark_rows')!s:>7} {r.get('oracle_rows')!s:>7} "
              f"{r.get('spark_sec')!s:>6}s {r['status'][:400]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
