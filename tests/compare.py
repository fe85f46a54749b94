"""Run registered queries on Spark and their SQL on DuckDB and compare rows exactly.

Usage: python tests/compare.py [sf] [name ...]
"""
from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("sheetloom-tests")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, fn, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for join in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if join in plan:
            return f"plan has {join}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    types = {c[0]: str(c[1]) for c in res.description}
    want = rows(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    for f in df.schema.fields:
        t = TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if t != types[f.name]:
            return f"type of {f.name}: {t} / {types[f.name]}"
    if len(got) != len(want):
        return f"{len(got)} / {len(want)} rows; " + first_difference(got, want)
    return None if got == want else first_difference(got, want)


def first_difference(got, want) -> str:
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"only spark {sorted(a - b)[:3]} only sql {sorted(b - a)[:3]} ({len(a - b)}/{len(b - a)})"


def main() -> int:
    import workload
    workload.load_all()
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(workload.QUERIES)
    spark, con = session(), duck(f"{DATA}/sf{sf}")
    bad = 0
    for name in names:
        t = time.time()
        try:
            if name in workload.SQL:
                diff = compare(spark, con, workload.QUERIES[name], workload.SQL[name], f"{DATA}/sf{sf}")
            else:
                n = len(workload.QUERIES[name](spark, f"{DATA}/sf{sf}").collect())
                diff = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:   # report and go on
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {time.time() - t:6.2f}s {name}" + (f"\n     {diff[:2000]}" if diff else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
