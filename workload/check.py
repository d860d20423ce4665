"""Compare registered queries with their SQL: ``python -m workload.check [sf_dir] [name part ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from clientlens.session import build_session
from workload import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(directory: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{directory}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, directory: str, name: str):
    """(ok, message, seconds)"""
    start = time.time()
    df = QUERIES[name](spark, directory)
    ours = df.collect()
    seconds = time.time() - start
    if name not in ORACLES:
        return True, f"{len(ours)} rows, no SQL", seconds
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}", seconds
    a, b = rows_of(df.columns, ours), rows_of(columns, theirs)
    if a == b:
        return True, f"{len(a)} rows", seconds
    only_a = [x for x, y in zip(a, b) if x != y][:2] if len(a) == len(b) else sorted(set(a) - set(b))[:2]
    only_b = [y for x, y in zip(a, b) if x != y][:2] if len(a) == len(b) else sorted(set(b) - set(a))[:2]
    return False, f"{len(a)} vs {len(b)} rows\n   ours   {only_a}\n   theirs {only_b}", seconds


def main(argv) -> int:
    directory = argv[0] if argv else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not argv[1:] or any(p in n for p in argv[1:])]
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(directory)
    bad = 0
    for name in names:
        try:
            ok, message, seconds = compare(spark, con, directory, name)
        except Exception as e:  # report every query
            ok, message, seconds = False, f"{type(e).__name__}: {str(e)[-2500:]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {seconds:6.2f}s {message}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
