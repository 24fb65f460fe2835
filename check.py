"""Run registered queries against their SQL on the same tables.

    python check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

from recallspark.session import local_session
from recallspark.suite import registry


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "__float__") and not isinstance(value, (int, str)):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    db = duckdb.connect()
    for path in glob.glob(f"{args.sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    queries, oracles = registry.queries(), registry.oracles()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name}: spark {str(error)[:1500]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"ok   {name}: {len(got)} rows, no SQL  ({took:.1f}s)")
            continue
        start = time.time()
        try:
            rel = db.execute(oracles[name])
            columns = [d[0] for d in rel.description]
            want = rel.fetchall()
        except Exception as error:
            print(f"FAIL {name}: sql {str(error)[:1500]}")
            bad += 1
            continue
        sql_took = time.time() - start
        mine, theirs = rows_of(df.columns, got), rows_of(columns, want)
        if sorted(df.columns) != sorted(columns):
            print(f"FAIL {name}: columns {df.columns} / {columns}")
            bad += 1
        elif mine != theirs:
            print(f"FAIL {name}: {len(mine)} / {len(theirs)} rows")
            a, b = set(mine), set(theirs)
            only, miss = list(a - b)[:3], list(b - a)[:3]
            print("   spark only:", [str(r)[:300] for r in only], "\n   sql only:  ", [str(r)[:300] for r in miss])
            bad += 1
        else:
            print(f"ok   {name}: {len(mine)} rows  ({took:.1f}s, sql {sql_took:.1f}s)")
        sys.stdout.flush()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
