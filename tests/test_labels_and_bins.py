"""Missing values and edges of the derived columns."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.functions import bins as B
from lineout.functions import labels as L
from lineout.operators import clean, joins, reports


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_outcomes_of_known_and_missing_events(spark):
    events = ["Single", "Hit a Double (ground rule)", "Triple", "Home Run", "Groundout", None]
    assert column(spark, events, "string", L.hit_flag) == [1, 1, 1, 1, 0, 0]
    assert column(spark, events, "string", L.hit_type) == [1, 2, 3, 4, 0, 0]
    assert column(spark, [0, 1, 2, 3, 4, None], "int", L.run_value) == [0.0, 0.462, 0.762, 1.03, 1.4, None]
    assert column(spark, [1, 2], "int", lambda c: L.run_value(c, {1: 0.5})) == [0.5, 0.0]


def test_missing_condition_gives_missing_label(spark):
    team = lambda c: L.fielding_team(c, F.lit("A"), F.lit("H"))
    assert column(spark, ["bot", "top", None], "string", team) == ["A", "H", None]
    assert column(spark, [75.0, 75.1, 100.0, 100.1, None], "double", L.velocity_range) == [
        "Less than 75 mph", "75 to 80 mph", "95 to 100 mph", "> 100 mph", None]
    assert column(spark, ["FF", "CU", None], "string", L.pitch_category) == ["Fastballs", "Other", "Other"]
    assert column(spark, ["R", "L", "S", None], "string", lambda c: L.recode(c, S.STAND_LABELS)) == [
        "Right Handed Batter", "Left Handed Batter", None, None]
    assert column(spark, ["3-0", "0-2", "4-0", None], "string", lambda c: L.level_rank(c, S.COUNT_LEVELS)) == [
        1, 12, None, None]


def test_correctness_and_flags_propagate_missing(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, None, 0), (4, 0, 1)], "i int, fit int, hit int")
    rows = reports.with_correctness(reports.with_outcome_flags(df)).orderBy("i").collect()
    assert [r["miss"] for r in rows] == ["Correct", "Incorrect", None, "Incorrect"]
    assert [r["expected_outs_made"] for r in rows] == [1, 0, None, 0]
    assert [r["unexpected_outs_made"] for r in rows] == [0, 1, None, 0]
    assert [r["hit_label"] for r in rows] == ["Out", "Out", "Out", "Hit"]


def test_angle_level_with_the_plate_is_missing(spark):
    df = spark.createDataFrame([(138.0, 208.0), (138.0, 198.0), (None, 1.0)], "x double, y double")
    tan = [r[0] for r in df.select(L.horizontal_angle(F.col("x"), F.col("y"))).collect()]
    assert tan[0] is None and tan[2] is None
    assert tan[1] == pytest.approx(round(math.tan(1.0) * 180 / math.pi * 0.75, 1))
    atan = [r[0] for r in df.select(L.horizontal_angle(F.col("x"), F.col("y"), "atan", None)).collect()]
    assert atan[1] == pytest.approx(45 * 0.75)
    with pytest.raises(ValueError):
        L.horizontal_angle(F.col("x"), F.col("y"), "sin")


def test_regular_bins_are_right_closed_with_lowest_included(spark):
    values = [-90.0001, -90.0, -89.9, -80.0, -79.9, 0.0, 90.0, 90.1, None, float("nan")]
    ordinal = lambda c: B.regular_bin(c, *S.ANGLE_BINS)
    assert column(spark, values, "double", ordinal) == [None, 1, 1, 1, 2, 9, 18, None, None, None]
    label = lambda c: B.bin_label(ordinal(c), reports.ANGLE_EDGES)
    assert column(spark, values[:5], "double", label) == [None, "[-90,-80]", "[-90,-80]", "[-90,-80]", "(-80,-70]"]


def test_regular_bins_hold_at_edges_that_are_not_exact(spark):
    edges = B.regular_edges(0.0, 1.0, 0.1)
    ordinals = column(spark, edges, "double", lambda c: B.regular_bin(c, 0.0, 1.0, 0.1))
    assert ordinals == [1, *range(1, 11)]


def test_break_bins(spark):
    values = [-0.1, 0.0, 45.0, 45.1, 500.0, 501.0, None]
    ordinals = column(spark, values, "double", lambda c: B.break_bin(c, S.DISTANCE_BREAKS))
    assert ordinals == [None, 1, 1, 2, 11, None, None]


def test_label_texts(spark):
    assert column(spark, ["[0,10]", "(-80,-70]"], "string", B.round_brackets) == ["(0,10)", "(-80,-70)"]
    assert column(spark, ["[0,10]", "(-80,-70]"], "string", B.range_text) == ["0 to 10", "-80 to -70"]
    assert column(spark, [0.334, 0.36, None], "double", L.percent_text) == ["33.4%", "36.0%", None]


def test_bin_bounds_agree_with_the_bin(spark):
    df = spark.range(-90, 91).withColumn("b", B.regular_bin(F.col("id").cast("double"), *S.ANGLE_BINS))
    low, high = B.bin_bounds(F.col("b"), reports.ANGLE_EDGES)
    inside = ((F.col("id") > low) | ((F.col("id") == -90) & (low == -90))) & (F.col("id") <= high)
    assert df.filter(~inside | inside.isNull()).count() == 0


def test_cleaning(spark):
    raw = spark.createDataFrame([("null", "1.5"), ("abc", "null"), ("7", None)], "a string, b string")
    rows = clean.to_numbers(clean.blank_sentinel(raw), ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [(None, 1.5), (None, None), (7.0, None)]
    xy = spark.createDataFrame(
        [(1.0, 50.0), (50.0, 1.0), (1.0, 1.0), (None, 50.0), (50.0, 50.0)], "hc_x double, hc_y double")
    assert [tuple(r) for r in clean.drop_miscoded(xy).collect()] == [(50.0, 50.0)]
    events = spark.createDataFrame([("Sac Bunt",), ("Single",), (None,)], "events string")
    assert {r[0] for r in clean.exclude(events, "events", S.BUNT_EVENTS).collect()} == {"Single", None}
    assert {r[0] for r in reports.without_home_runs(events).collect()} == {"Sac Bunt", "Single"}


def test_column_range_follows_table_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert clean.column_range(df, "b", "d") == ["b", "c", "d"]
    assert clean.column_range(df, "d", "b") == ["d", "c", "b"]


def test_row_key_tells_missing_from_text_and_ignores_partitioning(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("", "a")], "x string, y string")
    keyed = clean.with_row_key(df, ["x", "y"])
    keys = {r["row_key"] for r in keyed.collect()}
    assert len(keys) == 3
    assert keys == {r["row_key"] for r in clean.with_row_key(df.repartition(3), ["x", "y"]).collect()}


def test_null_keys_match_in_bucket_join(spark):
    left = spark.createDataFrame([(None, 1, 0.5), (2, 2, 0.6)], "a int, b int, p double")
    right = spark.createDataFrame([(None, 1, 7), (2, 3, 8)], "a int, b int, n int")
    rows = {tuple(r) for r in joins.null_safe_join(left, right, ["a", "b"]).collect()}
    assert rows == {(None, 1, 0.5, 7), (2, 2, 0.6, None)}


def test_zone_code_keeps_one_row_per_pitch_and_scales_by_height(spark):
    pitches = spark.createDataFrame(
        [(1, "R", 0.0, 2.0, 72.0), (2, "L", 5.0, 2.0, 72.0), (3, "R", None, 2.0, 72.0), (4, "R", 0.0, 2.0, 36.0),
         (5, "S", 0.0, 2.0, 72.0)],
        "i int, stand string, px double, pz double, b_height double")
    zones = spark.createDataFrame(
        [("R", -1.0, 1.0, 1.5, 3.0, "a"), ("R", -1.0, 1.0, 1.5, 3.0, "b"), ("L", -1.0, 1.0, 1.5, 3.0, "a")],
        S.ZONE_SCHEMA)
    plain = {r["i"]: r["location"] for r in joins.zone_code(pitches, zones).collect()}
    assert plain == {1: "a", 2: "Out of Zone", 3: "Out of Zone", 4: "a", 5: "Out of Zone"}
    scaled = {r["i"]: r["location"] for r in joins.zone_code(pitches, zones, height="b_height").collect()}
    assert scaled[4] == "Out of Zone" and scaled[1] == "a"


def test_zone_code_finds_the_first_of_many_zones(spark):
    grid = [(i, "R", i / 10 - 50, i / 10 - 49, 0.0, 100.0, f"z{i}") for i in range(1000)] + [(2000, "R", -1e9, 1e9, -1e9, 1e9, "far")]
    zones = spark.createDataFrame(grid, "ord int, " + S.ZONE_SCHEMA)
    pitches = spark.createDataFrame([(i, "R", i * 0.7 - 60, 1.0) for i in range(200)], "i int, stand string, px double, pz double")
    for row in joins.zone_code(pitches, zones).collect():
        first = next(z[6] for z in grid if z[2] <= row["px"] <= z[3] and z[4] <= row["pz"] <= z[5])
        assert row["location"] == first
