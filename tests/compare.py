"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def compare(spark, con, name, query, sql, root):
    """Returns (status, seconds, message)."""
    start = time.time()
    df = query(spark, root)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("rows-only", took, f"{len(rows)} rows")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return ("COLUMNS", took, f"{sorted(df.columns)} vs {sorted(names)}")
    got, want = as_rows(df.columns, rows), as_rows(names, expected)
    if len(got) != len(want):
        return ("ROWCOUNT", took, f"{len(got)} vs {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return ("VALUES", took, f"{len(bad)} of {len(got)} rows, columns {sorted(names)}: {bad[:2]}")
    return ("ok", took, f"{len(rows)} rows")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from duecast.session import build

    root = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(root)
    sqls = entry.oracle_sql()
    failures = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, took, message = compare(spark, con, name, query, sqls.get(name), root)
        except Exception as error:  # report and go on with the next query
            status, took, message = "ERROR", 0.0, str(error)[:1500]
        failures += status not in ("ok", "rows-only")
        print(f"{status:10s} {took:6.2f}s {name}: {message}", flush=True)
    print("failures:", failures)
