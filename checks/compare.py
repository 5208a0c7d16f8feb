"""Runs registered queries against their DuckDB text: ``python -m checks.compare [name ...]``."""

import os
import sys
import time

import duckdb

from checks import load
from monthloom.session import get_spark

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(str(r[k]) for k in order) for r in rows))


def compare(spark, con, sf, name, queries, oracles):
    t = time.time()
    df = queries[name](spark, sf)
    rows = df.collect()
    took = time.time() - t
    if name not in oracles:
        return f"rows  {len(rows):>8}", took, len(rows) > 0
    t = time.time()
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck = time.time() - t
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {df.columns} vs {names}", took, False
    a, b = canonical(rows, df.columns), canonical(want, names)
    if a == b:
        return f"exact {len(a):>8}  (duckdb {duck:.1f}s)", took, len(a) > 0
    only = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"DIFF {len(a)} vs {len(b)}; e.g. {only} cols {sorted(names)}", took, False


def main(argv):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, oracles = load()
    spark = get_spark("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = []
    for name in argv or list(queries):
        try:
            text, took, ok = compare(spark, con, sf, name, queries, oracles)
        except Exception as e:
            text, took, ok = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0.0, False
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name:<28} {took:6.1f}s  {text}", flush=True)
    print(f"{len(bad)} bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
