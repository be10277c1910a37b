"""Run registered queries next to their SQL twins on the given tables and compare the rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = "/root/testdata"


def session(name: str = "aerodeck-tests") -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName(name)
            .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.streaming.stateStore.providerClass",
                    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
            .getOrCreate())


def engine(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
              "labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v!r}"


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, plan, sql, folder):
    t0 = time.time()
    df = plan(spark, folder)
    cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    dt = time.time() - t0
    n = sum(got.values())
    if sql is None:
        return ("rows" if n else "EMPTY"), n, dt, ""
    cur = con.execute(sql)
    ocols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return "COLUMNS", n, dt, f"{cols} != {ocols}"
    if got != want:
        a, b = got - want, want - got
        return "DIFF", n, dt, f"{sum(a.values())}/{sum(b.values())} of {sum(want.values())}\n   spark {list(a)[:2]}\n   sql   {list(b)[:2]}"
    return ("ok" if n else "EMPTY"), n, dt, ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf = sys.argv[1]
    picks = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{ROOT}/sf{sf}"
    con = engine(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, plan in entry.queries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            state, n, dt, note = compare(spark, con, name, plan, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            state, n, dt, note = "ERROR", 0, 0.0, str(e)[:900]
        bad += state not in ("ok", "rows")
        print(f"{state:8} {name:40} {n:8} {dt:6.2f}s {note}", flush=True)
    print("bad", bad)
