"""Compares registered queries with their SQL in DuckDB: ``python tests/check.py [--sf DIR] [name-prefix ...]``."""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 9)
        return str(int(v)) if v == int(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set temp_directory=''")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    cols = sorted(df.columns)
    left = sorted(tuple(plain(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    pos = [names.index(c) for c in cols]
    right = sorted(tuple(plain(r[i]) for i in pos) for r in cur.fetchall())
    if left == right:
        return None if left else "EMPTY"
    a, b = set(left), set(right)
    return f"rows {len(left)} vs {len(right)}\n   spark only: {list(a - b)[:2]}\n   sql only:   {list(b - a)[:2]}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry

    from codefacts.session import build_session

    spark = build_session("check", cpus=8)
    con = connect(args.sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t = time.time()
        try:
            if name in sqls:
                t1 = time.time()
                diff = compare(fn(spark, args.sf), con, sqls[name])
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                n = fn(spark, args.sf).count()
                diff = None if n else "EMPTY"
                state = f"rows={n}"
        except Exception as e:  # noqa: BLE001
            diff = "error"
            state = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        bad += diff is not None
        print(f"{name:45s} {time.time() - t:6.1f}s {state}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
