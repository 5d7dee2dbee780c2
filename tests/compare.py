"""Run registered queries and their SQL side by side on one scale folder.

python tests/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}'")
    con.execute("SET memory_limit = '8GB'")
    con.execute("SET max_temp_directory_size = '4GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        if v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(cols)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    got, gcols = canon(df.columns, rows)
    if sql is None:
        return True, f"rows-only {len(got)} rows {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want, wcols = canon([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    head = f"{len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if gcols != wcols:
        return False, f"{head} columns {gcols} != {wcols}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"{head} want {len(want)} rows\n   only spark {sorted(a - b)[:3]}\n   only duck  {sorted(b - a)[:3]}"
    return True, head


if __name__ == "__main__":
    import __spark_entry__ as entry
    from cladewise.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                               "spark.local.dir": "/tmp", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(sf), []
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in queries:
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, note = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as e:  # a failed query must not hide the others
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)
