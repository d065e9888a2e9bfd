"""Run a registered query and its SQL twin on the same tables and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(plain(v) for v in row) for row in zip(*columns)), key=repr)


def kinds(table) -> dict[str, str]:
    return {f.name: str(f.type).removeprefix("large_") for f in table.schema}


def check(spark, con, sf: str, name: str, run, sql: str | None) -> dict:
    started = time.time()
    got = run(spark, sf).toArrow()
    out = {"name": name, "sec": round(time.time() - started, 2), "rows": got.num_rows, "ok": True, "why": ""}
    if sql is None:
        return out
    started = time.time()
    want = con.sql(sql).to_arrow_table()
    out["sql_sec"] = round(time.time() - started, 2)
    if sorted(got.column_names) != sorted(want.column_names):
        return out | {"ok": False, "why": f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"}
    if kinds(got) != kinds(want):
        return out | {"ok": False, "why": f"types {kinds(got)} != {kinds(want)}"}
    left, right = rows_of(got), rows_of(want)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        why = f"{len(left)} vs {len(right)} rows; spark {str(only_left)[:700]} sql {str(only_right)[:700]}"
        return out | {"ok": False, "why": why}
    return out


def session(cores: int = 8):
    import tempfile

    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = session(), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in wanted or queries:
        try:
            print(check(spark, con, sf, name, queries[name], oracle.get(name)), flush=True)
        except Exception as exc:  # noqa: BLE001
            print({"name": name, "ok": False, "why": f"{type(exc).__name__}: {str(exc)[:1500]}"}, flush=True)
