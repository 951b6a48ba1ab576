"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lineout.queries.fixture import Tables
from lineout.sources.read import season_batters
from tests.conftest import SF_SMALL
from tests.oracle import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_SMALL)
    yield con
    con.close()


# Queries of the llm subpackage have their own tests.
OWN = sorted(name for name in QUERIES if name != "pipeline" and not name.startswith("op"))


@pytest.mark.parametrize("name", [name for name in OWN if name in SQL])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert differences(df, duck, SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", [name for name in OWN if name not in SQL])
def test_query_without_sql_returns_rows(spark, name):
    assert name in QUERIES and name not in SQL
    assert len(QUERIES[name](spark, SF_SMALL).collect()) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_returns_one_row_per_team(spark):
    df = entry.entry(spark)
    assert df.count() > 20 and "expected_outs_perc" in df.columns


def test_projection_has_the_documented_rows(spark):
    balls = Tables(spark, SF_SMALL).balls
    row = balls.agg(F.count(F.lit(1)), F.countDistinct("row_key"), F.count("p"), F.round(F.sum("p"), 6)).first()
    assert tuple(row) == (6000, 6000, 5401, 1444.558882)
    assert Tables(spark, SF_SMALL).clean.count() == 4521


def test_filters_and_columns_reach_the_scan(spark):
    df = Tables(spark, SF_SMALL).balls.filter(F.col("hit_speed") >= 90).select("row_key", "hit_angle")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hit_speed,90.0)" in plan
    assert "ReadSchema: struct<row_key:string,hit_speed:double,hit_angle:double>" in plan


def test_seasons_reach_the_scan_as_date_ranges(spark):
    df = season_batters(Tables(spark, SF_SMALL).balls, 1996)
    length = "spark.sql.maxMetadataStringLength"  # the plan's text abbreviates filters beyond it
    spark.conf.set(length, 10_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(length)
    assert "GreaterThanOrEqual(game_date,1996-01-01)" in plan and "LessThan(game_date,1997-01-01)" in plan
