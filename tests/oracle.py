"""Runs registered queries next to their SQL check: ``python tests/oracle.py [sf] [names...]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("TEST_DATA", "/root/testdata")


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, int):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    """None when the rows agree exactly, else a message."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = duck(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in checks:
                message = compare(session, con, name, fn, checks[name], sf_dir)
            else:
                n = len(fn(session, sf_dir).collect())
                message = None if n else "no rows"
        except Exception as problem:  # report and go on
            message = f"{type(problem).__name__}: {str(problem)[:600]}"
        if message:
            failed.append(name)
        print(f"{time.time() - start:6.1f}s {'ok  ' if not message else 'FAIL'} {name} {'' if name in checks else '(rows only) '}{message or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}")
