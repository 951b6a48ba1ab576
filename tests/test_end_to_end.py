"""Extract files in, reports and scores out; nothing but files in between."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.operators import joins
from lineout.plans import hit_probability, hit_type, launch_angle
from lineout.sources import read, write
from lineout.streaming.scoring import score_arriving

TEAMS = ["ARI", "ATL", "BAL", "KC "]


def extract_rows(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        speed, angle = rng.uniform(40, 115), rng.uniform(-60, 60)
        hit = speed > 75 and -10 < angle < 35
        event = rng.choice(["Groundout", "Flyout", "Bunt Groundout"]) if not hit else (
            "Single" if speed < 90 else "Double" if speed < 100 else "Home Run")
        row = dict.fromkeys(S.RAW_COLUMNS, "null")
        row |= {
            "batter": 100 + i % 7, "year": 2016, "game_pk": i, "game_date": f"2016-0{4 + i % 3}-1{i % 9}", "events": event,
            "des2": "In play, out(s)", "type": "X", "inning_topbot": rng.choice(["bot", "top"]),
            "home_team": rng.choice(TEAMS), "away_team": rng.choice(TEAMS), "stand": rng.choice("LR"),
            "balls": rng.randint(0, 3), "strikes": rng.randint(0, 2), "pitch_type": rng.choice(["FF", "CU"]),
            "start_speed": round(rng.uniform(70, 102), 1), "release_spin_rate": 2200, "px": round(rng.uniform(-2, 2), 2),
            "pz": round(rng.uniform(0, 5), 2), "hit_distance_sc": round(rng.uniform(0, 450), 1), "hit_speed": round(speed, 1),
            "hit_angle": round(angle, 1), "hc_x": round(rng.uniform(20, 240), 2), "hc_y": round(rng.uniform(30, 200), 2),
        }
        if i % 50 == 0:
            row["hit_speed"] = "null"
        if i % 60 == 1:
            row["hc_x"] = 1
        rows.append(row)
    return rows


def write_extracts(folder, rows):
    folder.mkdir()
    for batter in {r["batter"] for r in rows}:
        with open(folder / f"{batter}.csv", "w", newline="") as f:
            out = csv.DictWriter(f, S.RAW_COLUMNS)
            out.writeheader()
            out.writerows(r for r in rows if r["batter"] == batter)


@pytest.fixture(scope="module")
def season(tmp_path_factory):
    folder = tmp_path_factory.mktemp("season")
    write_extracts(folder / "raw", extract_rows(1500))
    return folder


def test_extracts_are_read_as_declared(spark, season):
    raw = read.read_extracts(spark, str(season / "raw"))
    assert raw.columns == list(S.RAW_COLUMNS) and raw.count() == 1500
    assert raw.filter(F.col("hit_speed").isNull()).count() == 30
    assert read.season_batters(raw.withColumn("batter", F.col("batter").cast("long")), 2016).count() == 7
    bad = season / "bad"
    bad.mkdir()
    (bad / "x.csv").write_text(",".join(S.RAW_COLUMNS) + "\n1,2016\n")
    broken = read.read_extracts(spark, str(bad), keep_corrupt=True).cache()
    assert broken.filter(F.col(S.CORRUPT_COLUMN).isNotNull()).count() == 1


def test_hit_model_from_files_to_reports_and_back(spark, season):
    raw = read.read_extracts(spark, str(season / "raw"))
    out = str(season / "out")
    hit_probability.run(raw, out, until="2016-06-15", trees=10, depth=6)
    table = spark.read.option("header", True).csv(f"{out}/probability_of_hit")
    assert table.columns == ["Launch Angle Range (degrees)", "Exit Velocity Range (mph)", "Predicted Probability of a Hit"]
    assert table.filter(~F.col("Predicted Probability of a Hit").rlike(r"^\d+\.\d%$")).count() == 0
    teams = spark.read.option("header", True).csv(f"{out}/conversion_by_team")
    assert teams.columns == list(hit_probability.TEAM_NAMES)
    assert {r["fieldingTeam"].strip() for r in teams.collect()} == {"ARI", "ATL", "BAL", "KC"}
    sizes = {r["split"]: (int(r["n"]), int(r["total"])) for r in spark.read.option("header", True).csv(f"{out}/split_sizes").collect()}
    total = sizes["train"][1]
    assert sum(n for n, _ in sizes.values()) == total and sizes["train"][0] == round(total * 0.15)
    # Team sums over the rows outside training add up to those rows.
    rest = total - sizes["train"][0]
    assert sum(int(r["expected_outs_total"]) + int(r["expected_hits_total"]) for r in teams.collect()) == rest
    assert spark.read.parquet(f"{out}/scale").count() == 5
    assert spark.read.parquet(f"{out}/levels_home_team").count() == 4

    scored = hit_probability.score_new(write.load_model(f"{out}/model"), raw)
    p = {r["row_key"]: r["p"] for r in scored.collect()}
    assert len(p) == 1470 and all(0 <= v <= 1 for v in p.values())

    # The same model as a stream over files that arrive later, picked up once each.
    incoming, done, check = season / "incoming", str(season / "scored"), str(season / "check")
    write_extracts(incoming, extract_rows(100, seed=1))
    score_arriving(spark, f"{out}/model", str(incoming), done, check).awaitTermination(120)
    first = spark.read.parquet(done).count()
    score_arriving(spark, f"{out}/model", str(incoming), done, check).awaitTermination(120)
    assert first == spark.read.parquet(done).count() == 98


def test_type_model_analyses(spark, season):
    raw = read.read_extracts(spark, str(season / "raw"))
    prepared = hit_probability.prepare(raw)
    forests = hit_type.type_forests(prepared, trees=5, depth=4)
    assert set(forests) == {"default", "mtry 3", "spray angle", "hits only", "hits only, mtry 3"}
    assert {r["class"] for r in forests["default"].collect()} >= {0, 1, 2, 4}
    staged = hit_type.two_stage(prepared, trees=5, depth=4)
    assert staged.filter((F.col("expected_run_value") < 0) | (F.col("expected_run_value") > 1.4)).count() == 0
    others = hit_type.other_classifiers(prepared)
    rows = prepared.filter(F.col("split") != "train").count()
    assert sum(r["n"] for r in others["naive bayes"].collect()) == rows
    assert sum(r["n"] for r in others["kernel machine"].collect()) == rows


def test_model_comparison_has_baselines(spark, season):
    prepared = hit_probability.prepare(read.read_extracts(spark, str(season / "raw")))
    sets = {"model 5": hit_probability.models.FEATURE_SETS["model 5"]}
    table = {r["metric"]: r for r in hit_probability.compare_models(prepared, sets, trees=5, depth=5).collect()}
    assert table["recall"]["all hits"] == 1.0 and table["specificity"]["all outs"] == 1.0
    assert table["accuracy"]["model 5"] > table["accuracy"]["all outs"]


def test_launch_angle_study(spark, season):
    pitches = hit_probability.clean.clean_extract(
        hit_probability.clean.with_row_key(read.read_extracts(spark, str(season / "raw")), S.RAW_COLUMNS))
    heights = spark.createDataFrame([(100 + i, 70.0 + i) for i in range(6)], "batter long, b_height double")
    prepared = launch_angle.prepare(pitches, heights).cache()
    assert prepared.filter(F.col("events").startswith("Bunt")).count() == 0
    assert prepared.filter(F.col("b_height").isNull()).select("batter").distinct().count() == 1
    means = launch_angle.mean_tables(prepared)
    assert means["by_side"].count() == 2 and means["by_count"].count() <= 24
    tests = launch_angle.variance_tables(prepared)
    assert tests["anova_velocity_range"].count() == 4
    plots = launch_angle.plot_tables(prepared)
    for name, table in plots.items():
        assert table.count() > 0, name


def test_function_per_key_sees_each_key_once(spark):
    import pandas as pd

    keys = spark.createDataFrame([(1, 2016)] * 50 + [(2, 2016)], "batter long, year int")
    fn = lambda batter, year: pd.DataFrame({"batter": batter, "row": range(3)})
    rows = joins.apply_per_key(keys, fn, "batter long, row int", rows=2).collect()
    assert sorted(map(tuple, rows)) == [(b, i) for b in (1, 2) for i in range(3)]
