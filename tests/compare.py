"""Run queries against their SQL; ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def session(shuffle: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def database(folder: str):
    import duckdb

    from workload.views import TABLES

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"f{float(value) + 0.0!r}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, run, sql):
    """``None`` if equal, else what differs."""
    df = run(spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if got[1] == want[1]:
        return None if got[1] else "equal but empty"
    missing = [r for r in want[1] if r not in set(got[1])][:3]
    extra = [r for r in got[1] if r not in set(want[1])][:3]
    return f"rows {len(got[1])} / {len(want[1])}; spark only {extra}; sql only {missing}"[:1500]


if __name__ == "__main__":
    from workload import registry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(registry.QUERIES)
    spark, con = session(), database(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in chosen:
        begun = time.time()
        try:
            problem = compare(spark, con, folder, name, registry.QUERIES[name], registry.SQL.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - begun:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} of {len(chosen)} differ")
