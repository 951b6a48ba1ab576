"""ROC, cutoffs, metrics, and the identities of the published results."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lineout.operators import evaluate, reports
from lineout.operators.running import running_totals


def scores(spark, pairs):
    return spark.createDataFrame([(float(p), h) for p, h in pairs], "p double, hit int")


def brute_roc(pairs):
    p, n = sum(h for _, h in pairs), sum(1 - h for _, h in pairs)
    points = [(math.inf, 0, 0)]
    for cut in sorted({s for s, _ in pairs}, reverse=True):
        points.append((cut, sum(h for s, h in pairs if s >= cut), sum(1 - h for s, h in pairs if s >= cut)))
    return [(c, tp, fp, tp / p if p else None, fp / n if n else None) for c, tp, fp in points]


def sorted_roc(df):
    return sorted((tuple(r) for r in evaluate.roc_curve(df).collect()), key=lambda r: -r[0])


@pytest.mark.parametrize("kind", ["ties", "distinct", "separated", "one class"])
def test_roc_equals_brute_force(spark, kind):
    rng = random.Random(3)
    pairs = {
        "ties": [(rng.randint(0, 5) / 5, rng.randint(0, 1)) for _ in range(200)],
        "distinct": [(rng.random() ** 6, rng.randint(0, 1)) for _ in range(900)],
        "separated": [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)],
        "one class": [(0.5, 1), (0.4, 1)],
    }[kind]
    got = sorted_roc(scores(spark, pairs))
    assert got == brute_roc(pairs)
    rates = [(r[3], r[4]) for r in got]
    if kind != "one class":
        assert rates[0] == (0, 0) and rates[-1] == (1, 1)
        assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(rates, rates[1:]))


def test_missing_scores_are_left_out(spark):
    df = spark.createDataFrame([(0.5, 1), (None, 1), (0.2, 0)], "p double, hit int")
    assert [r[:3] for r in sorted_roc(df)] == [(math.inf, 0, 0), (0.5, 1, 0), (0.2, 1, 1)]


def test_cutoff_ties_go_to_the_highest(spark):
    # (fpr 0, tpr .5) and (fpr .5, tpr 1) are equally far from the corner.
    df = scores(spark, [(0.9, 1), (0.6, 0), (0.6, 1), (0.1, 0)])
    best = evaluate.best_cutoff(evaluate.roc_curve(df)).first()
    assert (best["cutoff"], best["sensitivity"], best["specificity"]) == (0.9, 0.5, 1.0)
    assert [r["fit"] for r in evaluate.apply_cutoff(df, 0.6).orderBy("p").collect()] == [0, 0, 0, 1]
    assert [r["fit"] for r in evaluate.apply_cutoff(df, 0.6, inclusive=True).orderBy("p").collect()] == [0, 1, 1, 1]


def test_running_totals_with_one_group_holding_most_values(spark):
    rng = random.Random(1)
    rows = [("big" if rng.random() < 0.9 else "small", float(i), rng.randint(0, 9)) for i in range(2000)] + [(None, 1.0, 4)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = running_totals(df, "v", ["n"], by=["g"], buckets=16).collect()
    assert len(got) == len(rows)
    want, totals = {}, {}
    for g, v, n in sorted(rows, key=lambda r: r[1]):
        totals[g] = totals.get(g, 0) + n
        want[g, v] = totals[g]
    assert all(r["cum_n"] == want[r["g"], r["v"]] and r["total_n"] == totals[r["g"]] for r in got)


def test_metrics_with_no_predicted_positive(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, None)], "hit int, fit int")
    row = evaluate.metrics(df).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 0, 1, 1)
    assert row["precision"] is None and row["f1"] is None and row["recall"] == 0.0
    assert sum(r["n"] for r in evaluate.confusion(df).collect()) == 2


def test_class_metrics_match_direct_counts(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 4), rng.randint(0, 3)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for row in evaluate.class_metrics(df, "a", "b").collect():
        c = row["class"]
        assert row["tp"] == sum(a == c and b == c for a, b in pairs)
        assert row["fp"] == sum(a != c and b == c for a, b in pairs)
        assert row["fn"] == sum(a == c and b != c for a, b in pairs)
        assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 300


def test_constant_baselines_of_the_published_table(spark):
    df = spark.range(10_000).select((F.col("id") < 3000).cast("int").alias("hit"))
    rows = {r["model"]: r for r in evaluate.baselines(df, share=0.3).collect()}
    assert rows["all hits"]["recall"] == 1.0 and rows["all hits"]["precision"] == pytest.approx(0.3)
    assert rows["all hits"]["f1"] == pytest.approx(0.46, abs=0.002)
    assert rows["all outs"]["specificity"] == 1.0 and rows["all outs"]["accuracy"] == pytest.approx(0.7)
    assert rows["all outs"]["precision"] is None
    assert rows["coin flip"]["recall"] == pytest.approx(0.3)


def test_comparison_table_has_metrics_down_and_models_across(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", 1, 1), ("b", 0, 0)], "model string, hit int, fit int")
    table = evaluate.comparison_table(evaluate.metrics(df, by=["model"]), ["a", "b"])
    got = {r["metric"]: (r["a"], r["b"]) for r in table.collect()}
    assert got["precision"] == (0.5, 1.0) and set(got) == set(evaluate.METRICS)


# Published counts of the final model over the 30 teams, and two team rows.
TN, FP, FN, TP = 14841, 3673, 3233, 6975


def test_published_confusion_gives_the_published_rates(spark):
    rows = [(0, 0, TN), (0, 1, FP), (1, 0, FN), (1, 1, TP)]
    counts = spark.createDataFrame(rows, "hit int, fit int, n int")
    df = counts.select("hit", "fit", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    row = evaluate.metrics(df).first()
    rates = [round(row[m], 3) for m in ("recall", "precision", "specificity", "accuracy")]
    assert rates == [0.683, 0.655, 0.802, 0.760]
    assert df.count() == 28722


def test_published_team_rows(spark):
    # ARI: 597 expected outs, 485 made; 409 expected hits, 127 turned into outs; 961 balls without 45 home runs.
    cells = [(0, 0, "Groundout", 485), (0, 1, "Single", 104), (0, 1, "Home Run", 8),
             (1, 0, "Groundout", 127), (1, 1, "Single", 245), (1, 1, "Home Run", 37)]
    counts = spark.createDataFrame([("ARI", *c) for c in cells], "fielding_team string, fit int, hit int, events string, n int")
    df = counts.select("fielding_team", "fit", "hit", "events", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    team = reports.conversion_by_team(df).first()
    assert (team["expected_outs_total"], team["expected_outs_converted"]) == (597, 485)
    assert (team["unexpected_outs_converted"], team["expected_hits_total"]) == (127, 409)
    assert team["expected_outs_perc"] == pytest.approx(0.812395309882747, abs=1e-12)
    assert team["unexpected_outs_perc"] == pytest.approx(0.310513447432763, abs=1e-12)
    average = reports.average_by_team(df).first()
    assert average["n"] == 961 and average["expected_ba"] == pytest.approx(0.387096774193548, abs=1e-12)
    assert average["actual_ba"] == pytest.approx(0.363163371488033, abs=1e-12)
    total = team["expected_outs_total"] + team["expected_hits_total"]
    outs = team["expected_outs_converted"] + team["unexpected_outs_converted"]
    assert average["actual_ba"] * average["n"] == pytest.approx(total - outs - (total - average["n"]))


def test_bucket_table_sorts_as_text_or_by_range(spark):
    rows = [(9, 11, 0.45), (9, 2, 0.36), (9, 1, 0.334)]
    df = spark.createDataFrame(rows, "angle_bin int, speed_bin int, ave_prob double")
    text = [tuple(r) for r in reports.bucket_display(df, order="label").collect()]
    assert text == [("-10 to 0", "0 to 10", "33.4%"), ("-10 to 0", "10 to 20", "36.0%"), ("-10 to 0", "100 to 110", "45.0%")]
    assert [r[1] for r in reports.bucket_display(df).collect()] == ["0 to 10", "10 to 20", "100 to 110"]
