"""Run a query on Spark and its SQL on DuckDB, and compare them row for row."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(folder) / table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)  # + 0.0 turns -0.0 into 0.0
    return value if value is None else str(value)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


def differences(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description of the first difference."""
    got_names, got = _table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want_names, want = _table(list(kinds), cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    spark_kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    for name, kind in spark_kinds.items():
        if kinds[name] not in ("NUMBER", "STRING", "Date") and pairs.get(kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(got_names, a))} != {dict(zip(got_names, b))}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            result = differences(df, con, sql[name]) if name in sql else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001  (report and go on)
            result = "FAILED " + str(error).strip()[:600]
        bad += bool(result) and not result.startswith("rows only")
        print(f"{time.time() - start:6.2f}s {name}: {result or 'ok'}", flush=True)
    print("bad:", bad)
