"""Run registered queries on Spark and DuckDB side by side.

    python tools/check_oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SQL_SECONDS = 90  # a statement beyond this is interrupted and reported

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value if value != int(value) else int(value)
    if type(value).__name__ == "Decimal":
        return canonical(float(value)) if value != value.to_integral_value() else int(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [canonical(item) for item in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([canonical(row[i]) for i in order]) for row in rows))


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def compare(spark, con, item, folder):
    """(ok, message) for one registered query."""
    started = time.time()
    frame = item.run(spark, folder)
    columns = frame.columns
    got = rows_of(columns, [tuple(row) for row in frame.collect()])
    if item.sql is None:
        return True, f"rows only: {len(got)}"
    spark_done = time.time()
    watchdog = threading.Timer(SQL_SECONDS, con.interrupt)
    watchdog.start()
    try:
        cursor = con.execute(item.sql)
        names = [entry[0] for entry in cursor.description]
        want = rows_of(names, cursor.fetchall())
    finally:
        watchdog.cancel()
    spent = f"spark {spark_done - started:.1f}s, sql {time.time() - spark_done:.1f}s"
    if sorted(names) != sorted(columns):
        return False, f"columns {sorted(columns)} <> {sorted(names)}"
    if got != want:
        only_got = [row for row in got if row not in set(want)][:3]
        only_want = [row for row in want if row not in set(got)][:3]
        return False, f"{len(got)} <> {len(want)} rows; spark only {only_got}; sql only {only_want}"
    return True, f"{len(got)} rows ({spent})"


def main() -> int:
    from querydelta.registry import load
    from querydelta.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="session settings")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    for setting in args.set:
        spark.conf.set(*setting.split("=", 1))
    import logging

    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    con = duck(args.sf)
    bad = 0
    for name, item in load().items():
        if args.names and not any(name.startswith(prefix) for prefix in args.names):
            continue
        started = time.time()
        try:
            ok, message = compare(spark, con, item, args.sf)
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - started:6.2f}s {name}: {message}", flush=True)
    print(f"failed: {bad}")
    return int(bad > 0)


if __name__ == "__main__":
    raise SystemExit(main())
