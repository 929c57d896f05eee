"""Compare queries with their oracles: row count, column names, value hash (order-insensitive).

    python -m workload.check [--sf DIR] [--only name,name] [--skip name]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import time
from collections import Counter

import duckdb

from paperloom.session import get_session
from workload import load_all
from workload.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in data)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--skip", default="")
    args = parser.parse_args()
    load_all()
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    only = [n for n in args.only.split(",") if n]
    skip = set(args.skip.split(","))
    bad = []
    for name, fn in QUERIES.items():
        if (only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only)) or name in skip:
            continue
        try:
            t0 = time.time()
            df = fn(spark, args.sf)
            got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            n = sum(got.values())
            if name not in ORACLES:
                print(f"ROWS {name}: {n} rows, spark {t1 - t0:.1f}s")
                continue
            cur = con.execute(ORACLES[name])
            want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
            t2 = time.time()
            if got_cols != want_cols:
                raise AssertionError(f"columns {got_cols} != {want_cols}")
            if got != want:
                missing, extra = want - got, got - want
                raise AssertionError(
                    f"{n} vs {sum(want.values())} rows; missing {sum(missing.values())} {list(missing)[:3]}; "
                    f"extra {sum(extra.values())} {list(extra)[:3]}"
                )
            print(f"OK   {name}: {n} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s{'' if n else '  EMPTY'}")
        except Exception as e:  # report every query
            bad.append(name)
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}")
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
