"""Run registered queries against DuckDB on the same tables: python tests/compare.py [--sf DIR] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(value):
    if value is None or value is pd.NaT:
        return "∅"
    if isinstance(value, float):
        if math.isnan(value):
            return "∅"
        return repr(value + 0.0)
    if hasattr(value, "item"):
        return canon(value.item())
    if hasattr(value, "tolist"):
        return str([canon(v) for v in value.tolist()])
    if isinstance(value, (list, tuple)):
        return str([canon(v) for v in value])
    return str(value)


def rows(pdf: pd.DataFrame):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(canon(v) for v in r) for r in pdf.itertuples(index=False, name=None))


def kinds(pdf: pd.DataFrame):
    return {c: pdf[c].dtype.kind for c in sorted(pdf.columns)}


def check(spark, con, sf, name, fn, sql):
    t = time.time()
    got = fn(spark, sf).toPandas()
    took = time.time() - t
    if sql is None:
        return True, f"rows={len(got)} (no oracle) spark={took:.2f}s"
    t = time.time()
    want = con.execute(sql).df()
    otook = time.time() - t
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    note = f"rows={len(a)} spark={took:.2f}s duck={otook:.2f}s"
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:3]
        lack = [x for x in b if x not in set(a)][:3]
        return False, f"row count {len(a)} vs {len(b)} extra={extra} lack={lack}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ {note} e.g. {sorted(got.columns)} {bad[:2]}"
    if kinds(got) != kinds(want):
        note += f" KINDS {[(c, kinds(got)[c], kinds(want)[c]) for c in kinds(got) if kinds(got)[c] != kinds(want)[c]]}"
    if not a:
        note += " EMPTY"
    return True, note


def main():
    import __spark_entry__ as entry
    from pairgrammar.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    from pyspark.sql import SparkSession
    SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    fails = 0
    for name, fn in entry.queries().items():
        if args and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            ok, note = check(spark, con, sf, name, fn, entry.oracle_sql().get(name))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        fails += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("fails:", fails)


if __name__ == "__main__":
    main()
