"""Regression, analysis of variance, pairwise intervals, box summaries."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineout.operators import distributions as P
from lineout.operators import stats


def test_line_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    y = 2 + 3 * x + rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None)], "x double, y double")
    fit = stats.linear_fit(df, "y", "x").first()
    slope, intercept = np.polyfit(x, y, 1)
    residual = y - intercept - slope * x
    assert fit["n"] == 50
    assert (fit["slope"], fit["intercept"]) == pytest.approx((slope, intercept))
    assert fit["sigma"] == pytest.approx(np.sqrt(residual @ residual / 48))
    band = stats.trend_band(df, "y", "x", points=5).orderBy("x").collect()
    assert len(band) == 5 and all(r["lower"] < r["fit"] < r["upper"] for r in band)
    widths = [r["upper"] - r["lower"] for r in band]
    assert min(widths) == min(widths[1:4])
    assert widths[0] / 2 == pytest.approx(P.t_quantile(0.975, 48) * band[0]["se"])


def test_balanced_analysis_of_variance_by_hand(spark):
    # Cell means 1.5, 3.5, 5.5, 11.5 with two rows each.
    rows = [("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 3.0), ("a", "y", 4.0),
            ("b", "x", 5.0), ("b", "x", 6.0), ("b", "y", 11.0), ("b", "y", 12.0)]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    table = {r["term"]: r for r in stats.anova_two_way(df, "y", "a", "b").collect()}
    assert [table[t]["df"] for t in ("a", "b", "a:b", "Residuals")] == [1, 1, 1, 4]
    assert table["a"]["sum_sq"] == pytest.approx(72.0)
    assert table["b"]["sum_sq"] == pytest.approx(32.0)
    assert table["a:b"]["sum_sq"] == pytest.approx(8.0)
    assert table["Residuals"]["sum_sq"] == pytest.approx(2.0)
    assert table["a"]["f"] == pytest.approx(144.0)
    assert table["a"]["p"] == pytest.approx(P.f_upper(144.0, 1, 4))


def direct_sequential_ss(rows):
    """Sequential sums of squares from row-level least squares."""
    y = np.array([r[2] for r in rows])
    a, b = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    one = np.ones((len(rows), 1))
    da = np.array([[r[0] == v for v in a] for r in rows], float)
    db = np.array([[r[1] == v for v in b] for r in rows], float)
    dab = np.array([[(r[0], r[1]) == (u, v) for u in a for v in b] for r in rows], float)

    def rss(m):
        rest = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        return rest @ rest, np.linalg.matrix_rank(m)

    steps = [rss(m) for m in (one, np.hstack([one, da]), np.hstack([one, da, db]), dab)]
    return [(p[0] - q[0], q[1] - p[1]) for p, q in zip(steps, steps[1:])], steps[-1]


@pytest.mark.parametrize("empty", [False, True])
def test_unbalanced_analysis_of_variance(spark, empty):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice("xyzz"), rng.gauss(0, 3) + 100) for _ in range(200)]
    if empty:
        rows = [r for r in rows if r[:2] != ("b", "x")]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    got = stats.anova_two_way(df, "y", "a", "b").collect()
    terms, (residual, rank) = direct_sequential_ss(rows)
    for row, (ss, dof) in zip(got, terms):
        assert row["sum_sq"] == pytest.approx(ss, rel=1e-6, abs=1e-6) and row["df"] == dof
    assert got[3]["sum_sq"] == pytest.approx(residual) and got[3]["df"] == len(rows) - rank
    main = stats.main_effect(df, "y", "a").first()
    assert main["sum_sq"] == pytest.approx(terms[0][0], rel=1e-6)


def test_either_factor_may_have_many_levels(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 9_000).alias("many"), (F.col("id") % 7 % 3).alias("few"), F.sin(F.col("id") * 1.7).alias("y"))
    one, two = (stats.anova_two_way(df, "y", *order).collect() for order in (("many", "few"), ("few", "many")))
    assert one[0]["df"] == two[1]["df"] == 8999 and one[1]["df"] == two[0]["df"] == 2
    assert one[0]["sum_sq"] + one[1]["sum_sq"] == pytest.approx(two[0]["sum_sq"] + two[1]["sum_sq"])
    assert one[2]["sum_sq"] == pytest.approx(two[2]["sum_sq"]) and one[2]["df"] == two[2]["df"]


def test_tail_probabilities_match_published_tables():
    assert P.f_upper(4.96, 1, 10) == pytest.approx(0.05, abs=2e-4)
    assert P.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert P.tukey_quantile(0.95, 3, 10) == pytest.approx(3.877, abs=1e-3)
    assert P.tukey_quantile(0.95, 5, 20) == pytest.approx(4.232, abs=1e-3)
    # With two groups the studentised range is sqrt(2) times |t|.
    assert P.tukey_quantile(0.95, 2, 8) == pytest.approx(P.t_quantile(0.975, 8) * np.sqrt(2), abs=1e-3)


def test_tukey_pairs_on_a_balanced_design(spark):
    rng = random.Random(2)
    rows = [(a, b, rng.gauss({"a": 0, "b": 5}[a], 1)) for a in "ab" for b in "xyz" for _ in range(20)]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    table = stats.tukey_pairs(df, "y", "a", "b").collect()
    assert len(table) == 1 + 3 + 15
    first = next(r for r in table if r["term"] == "a")
    mean = {g: np.mean([r[2] for r in rows if r[0] == g]) for g in "ab"}
    assert first["diff"] == pytest.approx(mean["b"] - mean["a"])
    assert first["lower"] < first["diff"] < first["upper"] and first["p_adj"] < 1e-6


def test_tukey_pairs_of_uneven_cells_follow_the_fit(spark):
    rng = random.Random(3)
    rows = [(a, b, rng.gauss(ord(a) + 2 * ord(b), 3)) for a in "abc" for b in "wxyz" for _ in range(rng.randint(3, 30))]
    df = spark.createDataFrame(rows + [(None, "w", 1.0), ("a", "w", None)], "a string, b string, y double")
    table = {(r["term"], r["level_1"], r["level_2"]): r for r in stats.tukey_pairs(df, "y", "a", "b").collect()}
    assert len(table) == 3 + 6 + 66
    y = np.array([r[2] for r in rows])
    one = np.array([[1.0] + [float(r[0] == v) for v in "abc"] for r in rows])
    both = np.hstack([one, np.array([[float(r[1] == v) for v in "wxyz"] for r in rows])])
    fit = lambda x: x @ np.linalg.lstsq(x, y, rcond=None)[0]
    second = fit(both) - fit(one)
    cells = {}
    for r in rows:
        cells.setdefault(r[:2], []).append(r[2])
    within, dof = sum(np.var(v) * len(v) for v in cells.values()), len(rows) - len(cells)
    counts = {v: sum(r[1] == v for r in rows) for v in "wxyz"}
    for high, low in (("x", "w"), ("z", "y"), ("z", "w")):
        row = table["b", high, low]
        diff = second[[r[1] == high for r in rows]].mean() - second[[r[1] == low for r in rows]].mean()
        error = np.sqrt(within / dof / 2 * (1 / counts[high] + 1 / counts[low]))
        assert row["diff"] == pytest.approx(diff)
        assert row["upper"] - row["lower"] == pytest.approx(2 * P.tukey_quantile(0.95, 4, dof) * error, rel=1e-3)
        assert row["p_adj"] == pytest.approx(P.tukey_upper(abs(diff) / error, 4, dof), abs=1e-3)
    assert table["a:b", "c:z", "a:w"]["diff"] == pytest.approx(np.mean(cells["c", "z"]) - np.mean(cells["a", "w"]))


def test_tukey_pairs_without_residuals_or_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 3.0)], "a string, b string, y double")
    assert [(r["diff"], r["lower"], r["p_adj"]) for r in stats.tukey_pairs(df, "y", "a", "b").collect() if r["term"] == "a"] == [(2.0, None, None)]
    assert stats.tukey_pairs(df.limit(0), "y", "a", "b").count() == 0


@pytest.mark.parametrize("groups, df", [(2, 8), (3, 10), (7, 119), (7, 500), (14, 10_000)])
def test_tails_read_from_even_steps(groups, df):
    tails = P.tails_at(groups, df)
    assert P.width_at(tails, 0.95) == pytest.approx(P.tukey_quantile(0.95, groups, df), abs=1e-3)
    assert tails[150] == pytest.approx(P.tukey_upper(3.0, groups, df), abs=1e-4)


def numpy_box(values):
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    kept = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    return [q1, median, q3, min(kept), max(kept)], len(values) - len(kept)


def test_box_summary_equals_brute_force(spark):
    rng = random.Random(6)
    groups = {"big": [round(rng.gauss(0, 20), 1) for _ in range(3000)], "tiny": [5.0], "pair": [1.0, 9.0],
              "flat": [2.0] * 9, None: [rng.random() for _ in range(40)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("big", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for row in stats.box_summary(df, "v", ["g"]).collect():
        want, outliers = numpy_box(groups[row["g"]])
        got = [row[c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high")]
        assert got == pytest.approx(want) and row["n"] == len(groups[row["g"]]) and row["outliers"] == outliers


def test_smooth_follows_a_straight_line_exactly(spark):
    df = spark.range(400).select((F.col("id") / 100).alias("x"), (F.col("id") / 50 + 1).alias("y"))
    for row in stats.smooth_trend(df, "y", "x", 0.1, reach=4).collect():
        assert row["smooth"] == pytest.approx(2 * row["x"] + 1)


def test_mean_differences_covers_each_pair_once(spark):
    means = spark.createDataFrame([("a", 2, 1.0), ("b", 3, 4.0), ("c", 4, 9.0)], "g string, n long, mean double")
    got = {(r["level_1"], r["level_2"]): r["diff"] for r in stats.mean_differences(means, "g").collect()}
    assert got == {("b", "a"): 3.0, ("c", "a"): 8.0, ("c", "b"): 5.0}
