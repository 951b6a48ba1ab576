"""What moves and what is stored grows with the input, whatever its size. All rows are built here."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lineout.operators import joins, sampling
from lineout.queries import fixture
from lineout.queries.registry import all_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    day = datetime(1996, 5, 1)
    tables = {
        "nation": ([(n, f"N{n}") for n in range(3)], "n_nationkey int, n_name string"),
        "supplier": ([(s, s % 3) for s in range(4)], "s_suppkey long, s_nationkey int"),
        "customer": ([(c, c % 3) for c in range(5)] + [(4, 1)], "c_custkey long, c_nationkey int"),  # key 4 twice
        "orders": ([(o, o % 6 if o else None, ("1-URGENT", "2-HIGH", "5-LOW")[o % 3]) for o in range(30)],
                   "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([(o, o * 7 + n, (o + n) % 5, n, float(o + n), 900.0 + o, 0.01 * n, "RAN"[n % 3], "FO"[o % 2], day)
                      for o in range(32) for n in range(1, 8)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_projection_has_the_rows_of_its_sql(spark, folder):
    frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in fixture.SOURCES}
    expected = spark.sql(fixture.PROJECTION, **frames)
    ours = fixture.projected_balls(spark, folder)
    assert ours.columns == expected.columns
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, expected.collect())) and ours.count() > 100


def test_line_items_meet_orders_in_a_merge_join_at_any_size(spark, folder):
    plan = fixture.projected_balls(spark, folder)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin [l_orderkey") == 1


def test_single_readings_take_only_their_columns(spark, folder):
    recoded = all_queries()["d10_recode"](spark, folder)
    plan = recoded._jdf.queryExecution().sparkPlan().toString()
    assert "l_orderkey" in plan and "l_extendedprice" not in plan
    assert recoded.count() == fixture.projected_balls(spark, folder).count()


@pytest.mark.parametrize("rows", [0, 1, 7, 2000])
def test_stored_split_is_the_split(spark, rows):
    df = spark.range(rows).select(F.concat(F.lit("k"), "id").alias("row_key"), "id")
    ours, plain = sampling.stored_three_way_split(df), sampling.three_way_split(df)
    assert ours.columns == plain.columns
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_stored_split_keeps_null_keys_and_refuses_ties(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "row_key string")
    assert sorted(map(repr, sampling.stored_three_way_split(df).collect())) == sorted(map(repr, sampling.three_way_split(df).collect()))
    with pytest.raises(Exception, match="not unique"):
        sampling.stored_three_way_split(spark.createDataFrame([("a",)] * 20, "row_key string")).collect()


def test_per_key_tables_may_be_mappings(spark):
    def fn(key):
        return {"key": [key] * key, "row": list(range(key))}

    def mixed(key):
        import pandas as pd

        return pd.DataFrame(fn(key)) if key % 2 else fn(key)

    keys = spark.range(4).union(spark.range(4)).select(F.col("id").alias("key"))
    for some in (fn, mixed):
        rows = joins.apply_per_key(keys, some, "key long, row long", rows=2).collect()
        assert sorted(map(tuple, rows)) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
