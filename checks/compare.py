"""Run queries in Spark and their SQL in DuckDB and compare rows.

``python -m checks.compare [--sf 0.01] [name ...]``
"""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter

import duckdb

from certmill.session import local_session
from checks import queries as q

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark, con, name: str, sf_dir: str) -> tuple[str | None, int, float, float]:
    """None or what differs, the number of rows, and both run times."""
    t0 = time.time()
    df = q.run(name)(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    t1 = time.time()
    if name not in q.SQL:
        return None, len(got), t1 - t0, 0.0
    cur = con.execute(q.SQL[name])
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return f"columns {cols} / {sorted(names)}", len(got), t1 - t0, t2 - t1
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in rows]
    a, b = Counter(got), Counter(want)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"rows {len(got)} / {len(want)}\n   spark only {only_a}\n   sql only   {only_b}", len(got), t1 - t0, t2 - t1
    return None, len(got), t1 - t0, t2 - t1


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    a = args.parse_args()
    sf_dir = f"/root/testdata/sf{a.sf}"
    spark = local_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in a.names or q.QUERIES:
        try:
            diff, n, ts, td = difference(spark, con, name, sf_dir)
        except Exception as err:  # report and go on
            diff, n, ts, td = f"{type(err).__name__}: {str(err)[:700]}", 0, 0, 0
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name:24s} rows={n:7d} spark={ts:5.1f}s sql={td:5.1f}s"
              + (f"\n   {diff}" if diff else ""), flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
