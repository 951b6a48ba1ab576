"""Pipelines learn what they should, score row by row, and survive saving."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lineout.operators import bayes, features, models
from lineout.sources import write

TEAMS = ["AAA", "BBB", "CCC"]


@pytest.fixture(scope="module")
def balls(spark):
    """Fast, level balls are hits; faster still means more bases."""
    rng = random.Random(0)
    rows = []
    for i in range(1200):
        speed, angle = rng.uniform(40, 110), rng.uniform(-60, 60)
        hit = int(speed > 75 and -10 < angle < 35)
        kind = (1 if speed < 85 else 2 if speed < 95 else 4) if hit else 0
        rows.append((f"k{i}", speed, angle, rng.uniform(0, 400), rng.choice("LR"), rng.choice(TEAMS), rng.choice(TEAMS), hit, kind))
    schema = ("row_key string, hit_speed double, hit_angle double, hit_distance_sc double, stand string, "
              "fielding_team string, home_team string, hit int, hit_type int")
    return spark.createDataFrame(rows, schema).cache()


def accuracy(df, label, fit="fit"):
    return df.agg(F.avg((F.col(label) == F.col(fit)).cast("double"))).first()[0]


def test_hit_forest_scores_rows_and_survives_saving(spark, balls, tmp_path):
    model = models.forest(*models.FEATURE_SETS["model 5"], trees=15, depth=6).fit(balls)
    scored = models.score_hits(model, balls)
    assert scored.columns == [*balls.columns, "p"]
    assert accuracy(scored.withColumn("fit", (F.col("p") > 0.5).cast("int")), "hit") > 0.95
    write.save_model(model, str(tmp_path / "m"))
    again = models.score_hits(write.load_model(str(tmp_path / "m")), balls)
    one, two = ({r["row_key"]: r["p"] for r in df.collect()} for df in (scored, again))
    assert one == pytest.approx(two)


def test_unknown_category_is_kept_apart_not_relabelled(spark, balls):
    model = features.index_saved_levels("home_team", ["AAA", "CCC"])
    df = spark.createDataFrame([("AAA",), ("CCC",), ("BBB",), (None,)], "home_team string")
    assert [r["home_team_index"] for r in model.transform(df).collect()] == [0.0, 1.0, 2.0, 2.0]
    forest = models.forest(*models.FEATURE_SETS["model 5"], trees=3, depth=3).fit(balls)
    new = balls.limit(5).withColumn("home_team", F.lit("ZZZ"))
    assert models.score_hits(forest, new).filter("p IS NULL").count() == 0


def test_type_forest_hits_only_and_two_stage(balls):
    hits_model = models.hits_only_forest(trees=10, depth=6).fit(models.only_hits(balls))
    assert models.class_labels(hits_model) == [1, 2, 4]
    held = models.score_classes(hits_model, models.only_hits(balls))
    assert accuracy(held, "hit_type") > 0.9
    first = models.forest(*models.TYPE_FEATURES, trees=10, depth=6).fit(balls)
    both = models.score_two_stage(first, hits_model, balls)
    assert both.count() == balls.count() > models.only_hits(balls).count()
    total = sum(F.col(f"prob_{k}") for k in range(5))
    assert both.filter(F.abs(total - 1) > 1e-9).count() == 0
    assert both.agg(F.max("prob_3")).first()[0] == 0.0
    assert accuracy(both, "hit_type") > 0.85


def test_permutation_importance_finds_the_features_that_matter(balls):
    numeric, categorical = models.FEATURE_SETS["model 5"]
    model = models.forest(numeric, categorical, trees=10, depth=6).fit(balls)
    loss = {r["feature"]: r["loss"] for r in models.permutation_importance(model, balls, [*numeric, *categorical]).collect()}
    assert min(loss["hit_speed"], loss["hit_angle"]) > 0.1 > max(loss["stand"], loss["home_team"])


@pytest.mark.parametrize("digits", [0, 2])
def test_donor_values_are_a_permutation(balls, digits):
    donors = models.donor_rows(balls.select("row_key", "hit_speed"), ["hit_speed"], digits=digits).collect()
    assert sorted(r["_donor"]["hit_speed"] for r in donors) == sorted(r["hit_speed"] for r in donors)
    assert sum(r["_donor"]["hit_speed"] != r["hit_speed"] for r in donors) > 1150


def test_searches_return_one_row_per_setting(balls):
    small = balls.limit(400)
    assert [r["trees"] for r in models.error_by_trees(small, small, [2, 5], ("hit_speed",), depth=3).collect()] == [2, 5]
    tuned = models.tune_mtry(small, small, ("hit_speed", "hit_angle"), ("stand",), trees=3, depth=3).collect()
    assert all(1 <= r["mtry"] <= 3 and 0 <= r["error"] <= 1 for r in tuned)


def test_held_out_rows_do_not_choose_features(spark):
    rng = random.Random(5)
    noise = [f"n{i}" for i in range(24)]
    rows = [(f"k{i}", rng.randint(0, 1), *[rng.random() for _ in noise]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_key string, hit int, " + ", ".join(f"{c} double" for c in noise))
    errors = {r["features"]: r["error"] for r in models.feature_count_error(df, noise, folds=3, trees=8, depth=3).collect()}
    assert sorted(errors) == [1, 3, 6, 12, 24] and sum(errors.values()) / 5 > 0.4  # noise: half of the rows


def test_spline_basis_sums_to_one_and_is_held_outside(spark):
    df = spark.range(-20, 121).select((F.col("id") / 1.0).alias("v"))
    place = features.spline_place_sql("v", 0, 100, 8)
    placed = df.selectExpr("v", *[f"{text} AS _{n}" for n, text in place.items()])
    curves = placed.selectExpr("v", *[f"{c} AS c{i}" for i, c in enumerate(features.spline_sql("_k", "_t", 8))])
    rows = {r["v"]: [r[f"c{i}"] for i in range(11)] for r in curves.collect()}
    assert all(sum(r) == pytest.approx(1.0) and min(r) >= 0 for r in rows.values())
    assert rows[-20.0] == rows[0.0] and rows[120.0] == rows[100.0]
    assert rows[50.0][4:7] == pytest.approx([1 / 6, 2 / 3, 1 / 6])


def test_spline_logit_learns_a_band(balls, tmp_path):
    ranges = {"hit_speed": (40.0, 110.0), "hit_angle": (-60.0, 60.0)}
    model = models.spline_logit(ranges, ["stand"], pieces=8).fit(balls)
    write.save_model(model, str(tmp_path / "gam"))
    assert accuracy(models.predict_only(write.load_model(str(tmp_path / "gam")), balls), "hit") > 0.9


def test_kernel_features_approach_the_radial_kernel(spark):
    df = spark.createDataFrame([(0.3, -0.2), (-0.5, 0.4)], "a double, b double")
    exprs = features.kernel_sql(["a", "b"], 0.7, size=400)
    rows = [list(r) for r in df.selectExpr(*exprs).collect()]
    inner = sum(x * y for x, y in zip(*rows))
    assert inner == pytest.approx(math.exp(-0.7 * (0.8**2 + 0.6**2)), abs=0.1)


def test_kernel_svm_beats_always_out(balls):
    parameters = features.scale_parameters(balls, ["hit_speed", "hit_angle"])
    scaled = features.apply_scale(balls, parameters, ["hit_speed", "hit_angle"], "_z")
    model = models.kernel_svm(["hit_speed_z", "hit_angle_z"], label="hit", size=24, iterations=10, gamma=1.0).fit(scaled)
    always_out = balls.agg(F.avg((F.col("hit") == 0).cast("double"))).first()[0]
    assert accuracy(models.predict_only(model, scaled), "hit") > always_out + 0.05


def test_scaling_gives_mean_zero_sd_one_and_handles_a_constant(spark, balls):
    columns = ["hit_speed", "hit_angle"]
    scaled = features.apply_scale(balls, features.scale_parameters(balls, columns), columns)
    again = features.scale_parameters(scaled, columns).first()
    assert [again["center_hit_speed"], again["center_hit_angle"]] == pytest.approx([0, 0], abs=1e-12)
    assert [again["scale_hit_speed"], again["scale_hit_angle"]] == pytest.approx([1, 1])
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r[0] for r in features.apply_scale(flat, features.scale_parameters(flat, ["v"]), ["v"]).collect()] == [None, None]


def test_naive_bayes_by_hand(spark):
    rows = [("x", 0.0, "a"), ("x", 2.0, "a"), ("y", 10.0, "b"), ("y", 12.0, "b"), ("y", 11.0, "a")]
    train = spark.createDataFrame(rows, "label string, v double, c string")
    fitted = bayes.fit_naive_bayes(train, "label", ["v"], ["c"])
    new = spark.createDataFrame([(1.0, "a"), (11.0, "b"), (None, "b"), (11.0, None), (None, None), (1.0, "new")], "v double, c string")
    fits = [r["fit"] for r in bayes.predict_naive_bayes(new, fitted, ["v"], ["c"]).collect()]
    # With nothing known the larger class wins; an unseen level counts the same for both.
    assert fits == ["x", "y", "y", "y", "y", "x"]


def test_forest_probabilities_are_shares(balls):
    model = models.forest(*models.FEATURE_SETS["model 4"], trees=3, depth=3).fit(balls)
    sums = model.transform(balls).select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
