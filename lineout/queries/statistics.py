"""Regression, analysis of variance and the tables behind the plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineout import schema as S
from lineout.operators import additive, clean, joins, reports, stats
from lineout.operators import distributions as P
from lineout.queries.derived import ZONED
from lineout.queries.evaluation import CALIBRATION, calibration
from lineout.queries.registry import query, r6, rounded

_FIT = """f AS (SELECT CAST(regr_count(empirical_ave, ave_prob) AS BIGINT) AS n, regr_slope(empirical_ave, ave_prob) AS slope,
 regr_intercept(empirical_ave, ave_prob) AS intercept, regr_r2(empirical_ave, ave_prob) AS r2,
 regr_avgx(empirical_ave, ave_prob) AS x_mean, regr_sxx(empirical_ave, ave_prob) AS sxx,
 regr_syy(empirical_ave, ave_prob) AS syy, regr_sxy(empirical_ave, ave_prob) AS sxy,
 min(ave_prob) AS x_min, max(ave_prob) AS x_max FROM calibration WHERE empirical_ave IS NOT NULL)"""
_SIGMA = "sqrt((syy - sxy * sxy / sxx) / (n - 2))"


@query("t1_linear_fit", f"""
WITH {CALIBRATION}, {_FIT}
SELECT n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM f""")
def _(t):
    fit = stats.linear_fit(calibration(t), "empirical_ave", "ave_prob").select("n", "slope", "intercept", "r2")
    return rounded(fit, "slope", "intercept", "r2")


@query("t2_residual_error", f"WITH {CALIBRATION}, {_FIT} SELECT n, round({_SIGMA}, 6) AS sigma FROM f")
def _(t):
    return rounded(stats.linear_fit(calibration(t), "empirical_ave", "ave_prob").select("n", "sigma"), "sigma")


@query("t3_cell_moments", """
SELECT stand, velocity_range, CAST(count(*) AS BIGINT) AS n, round(avg(hit_angle), 6) AS mean,
 round(var_pop(hit_angle), 6) AS variance FROM pitches WHERE velocity_range IS NOT NULL GROUP BY ALL""")
def _(t):
    cells = stats.cell_moments(t.pitches, "hit_angle", ["stand", "velocity_range"])
    return rounded(cells.select("*", (F.col("within") / F.col("n")).alias("variance")).drop("within"), "mean", "variance")


@query("t3_main_effect", """
WITH c AS (SELECT velocity_range, count(*) AS n, avg(hit_angle) AS m FROM pitches
 WHERE velocity_range IS NOT NULL GROUP BY ALL),
 g AS (SELECT sum(n * m) / sum(n) AS gm FROM c)
SELECT CAST(count(*) - 1 AS BIGINT) AS df, round(sum(n * (m - gm) * (m - gm)), 4) AS sum_sq FROM c, g""")
def _(t):
    return stats.main_effect(t.pitches, "hit_angle", "velocity_range").select("df", F.round("sum_sq", 4).alias("sum_sq"))


def _anova_sql(table: str, b: str) -> str:
    """Two-way analysis of variance in closed form, for a first factor with the levels L and R.

    With d the cell difference in a level of the second factor and h half the
    harmonic mean of its counts, the first factor explains (sum h d)^2 / sum h
    after the second.
    """
    return f"""cells AS (SELECT stand, {b} AS b, CAST(count(*) AS DOUBLE) AS n, avg(hit_angle) AS m, var_pop(hit_angle) * count(*) AS w
  FROM {table} WHERE hit_angle IS NOT NULL AND stand IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
 g AS (SELECT sum(n * m) / sum(n) AS g, sum(n) AS total, count(*) AS c, sum(w) AS w, count(DISTINCT b) AS k FROM cells),
 t AS (SELECT stand, b, n, n * (m - g) AS t FROM cells, g),
 first AS (SELECT sum(q) AS ss FROM (SELECT sum(t) * sum(t) / sum(n) AS q FROM t GROUP BY stand)),
 other AS (SELECT sum(q) AS ss FROM (SELECT sum(t) * sum(t) / sum(n) AS q FROM t GROUP BY b)),
 pairs AS (SELECT l.n * r.n / (l.n + r.n) AS h, l.t / l.n - r.t / r.n AS d FROM t l JOIN t r ON l.b = r.b AND l.stand = 'L' AND r.stand = 'R'),
 after AS (SELECT sum(h * d) * sum(h * d) / sum(h) AS ss FROM pairs),
 terms AS (
  SELECT 'stand' AS term, 1 AS df, first.ss FROM first
  UNION ALL SELECT '{b}', k - 1, other.ss + after.ss - first.ss FROM first, other, after, g
  UNION ALL SELECT 'stand:{b}', c - 1 - k, (SELECT sum(t * t / n) FROM t) - other.ss - after.ss FROM other, after, g
  UNION ALL SELECT 'Residuals', total - c, w FROM g)
SELECT term, CAST(df AS BIGINT) AS df, round(ss, 2) AS sum_sq, round(ss / df, 2) AS mean_sq,
 CASE WHEN term <> 'Residuals' THEN round(ss / df / (SELECT w / (total - c) FROM g), 4) END AS f FROM terms"""


def _anova(df, b: str):
    table = stats.anova_two_way(df, "hit_angle", "stand", b)
    return table.select("term", "df", F.round("sum_sq", 2).alias("sum_sq"), F.round("mean_sq", 2).alias("mean_sq"), F.round("f", 4).alias("f"))


@query("t3_anova_velocity", "WITH " + _anova_sql("pitches", "velocity_range"))
def _(t):
    return _anova(t.pitches, "velocity_range")


def _zoned(t):
    return joins.zone_code(t.pitches, joins.default_zones(t.spark))


@query("t3_anova_location", f"WITH {ZONED}, " + _anova_sql("zoned", "location"))
def _(t):
    return _anova(_zoned(t), "location")


def _tukey_sql(table: str, b: str, compared: tuple[int, ...]) -> str:
    """Pairs of levels in SQL, with the tails of the studentised range written out.

    The number of levels is counted from the data, so a table of tails is given for every
    number in ``compared``.
    """
    tails = ", ".join(
        f"({g}, [{', '.join(f'{v:.17g}' for v in P.range_tails(g, None))}], [{', '.join(f'{v:.17g}' for v in P.range_tails(g, float(P.LARGE)))}])" for g in compared
    )
    return f"""tails AS (SELECT * FROM (VALUES {tails}) AS t(g, far, near)),
 cells AS (SELECT stand AS a, {b} AS b, count(*) AS n, avg(hit_angle) AS mean, var_pop(hit_angle) * count(*) AS w FROM {table}
  WHERE hit_angle IS NOT NULL AND stand IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
 total AS (SELECT sum(n) - count(*) AS dof, sum(w) / (sum(n) - count(*)) AS noise, sum(n * mean) / sum(n) AS grand FROM cells),
 first AS (SELECT a, sum(n) AS n, sum(n * mean) / sum(n) AS mean FROM cells GROUP BY a),
 means AS (SELECT 'stand' AS term, a AS level, n, mean FROM first
  UNION ALL SELECT '{b}', b, sum(cells.n), (SELECT grand FROM total) + sum(cells.n * (cells.mean - first.mean)) / sum(cells.n)
   FROM cells JOIN first USING (a) GROUP BY b
  UNION ALL SELECT 'stand:{b}', a || ':' || b, n, mean FROM cells),
 sized AS (SELECT *, count(*) OVER (PARTITION BY term) AS g FROM means),
 pairs AS (SELECT x.term, x.g, x.level AS level_1, y.level AS level_2, x.mean - y.mean AS diff, sqrt(noise / 2 * (1e0 / x.n + 1e0 / y.n)) AS error, dof
  FROM sized x JOIN sized y ON x.term = y.term AND x.level > y.level, total),
 used AS (SELECT DISTINCT g, dof FROM pairs),
 steps AS (SELECT g, generate_subscripts(far, 1) - 1 AS i, unnest(far) + (unnest(near) - unnest(far)) * {P.LARGE} / dof AS tail FROM tails JOIN used USING (g)),
 next AS (SELECT *, lag(tail) OVER (PARTITION BY g ORDER BY i) AS before, lead(tail) OVER (PARTITION BY g ORDER BY i) AS after FROM steps),
 width AS (SELECT g, arg_min({P.STEP} * (i - (0.05e0 - tail) / (before - tail)), i) AS width FROM next WHERE tail <= 0.05e0 GROUP BY g),
 placed AS (SELECT pairs.*, abs(diff) / error / {P.STEP} AS spot, least(floor(abs(diff) / error / {P.STEP}), {P.STEPS - 1}) AS step FROM pairs)
SELECT term, level_1, level_2, round(diff, 6) AS diff, round(diff - width * error, 6) AS lower, round(diff + width * error, 6) AS upper,
 round(tail + (after - tail) * least(spot - step, 1e0), 6) AS p_adj
FROM placed JOIN width USING (g) JOIN next ON next.g = placed.g AND next.i = placed.step"""


def _tukey(df, b: str):
    return rounded(stats.tukey_pairs(df, "hit_angle", "stand", b), "diff", "lower", "upper", "p_adj")


@query("t4_tukey_velocity", "WITH " + _tukey_sql("pitches", "velocity_range", (2, 5, 6, 7, 11, 12, 13, 14)))
def _(t):
    return _tukey(t.pitches, "velocity_range")


@query("t4_tukey_location", f"WITH {ZONED}, " + _tukey_sql("zoned", "location", (2, *range(4, 23))))
def _(t):
    return _tukey(_zoned(t), "location")


@query("t4_mean_differences", """
WITH m AS (SELECT velocity_range AS level, count(*) AS n, avg(hit_angle) AS mean FROM pitches
 WHERE velocity_range IS NOT NULL GROUP BY ALL)
SELECT a.level AS level_1, b.level AS level_2, round(a.mean - b.mean, 6) AS diff, CAST(a.n AS BIGINT) AS n_1,
 CAST(b.n AS BIGINT) AS n_2 FROM m a JOIN m b ON a.level > b.level""")
def _(t):
    means = stats.cell_moments(t.pitches, "hit_angle", ["velocity_range"])
    return rounded(stats.mean_differences(means, "velocity_range"), "diff")


@query("t5_trend_band", f"""
WITH {CALIBRATION}, {_FIT},
 x AS (SELECT f.*, x_min + (x_max - x_min) * i / 19 AS x, {_SIGMA} AS sigma
  FROM f, (SELECT unnest(range(20)) AS i)),
 b AS (SELECT x, intercept + slope * x AS fit, sigma * sqrt(1e0 / n + (x - x_mean) * (x - x_mean) / sxx) AS se FROM x)
SELECT round(x, 6) AS x, round(fit, 6) AS fit, round(se, 6) AS se, round(fit - 1.96e0 * se, 6) AS lower,
 round(fit + 1.96e0 * se, 6) AS upper FROM b""")
def _(t):
    band = stats.trend_band(calibration(t), "empirical_ave", "ave_prob", points=20, critical=1.96)
    return rounded(band, *band.columns)


_BINS = """bins AS (SELECT stand, CAST(floor(px / 0.1e0) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n,
 avg(px) AS x, avg(hit_angle) AS y FROM pitches GROUP BY 1, 2)"""


@query("t6_binned_means", f"WITH {_BINS} SELECT stand, bin, n, round(x, 6) AS x, round(y, 6) AS y FROM bins")
def _(t):
    return rounded(stats.binned_means(t.pitches, "hit_angle", "px", 0.1, ["stand"]), "x", "y")


@query("t6_smooth_trend", f"""
WITH {_BINS},
 pairs AS (SELECT c.stand, c.x AS x0, c.n AS n0, b.y, b.x - c.x AS d,
  b.n * pow(1 - pow(least(abs(b.x - c.x) / (0.1e0 * 6), 1e0), 3), 3) AS w
  FROM bins c JOIN bins b ON b.stand = c.stand AND b.bin BETWEEN c.bin - 5 AND c.bin + 5),
 s AS (SELECT stand, x0, n0, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1
  FROM pairs GROUP BY ALL)
SELECT stand, round(x0, 6) AS x, n0 AS n,
 round(CASE WHEN s0 * s2 - s1 * s1 > 1e-12 * s0 * s2 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 6)
  AS smooth FROM s""")
def _(t):
    return rounded(stats.smooth_trend(t.pitches, "hit_angle", "px", 0.1, reach=5, by=["stand"]), "x", "smooth")


_FACET_X = {"px": (-1.5, 1.5), "hit_angle": (-80, 80), "hit_speed": (90, None)}


@query("t6_spline_band")
def _(t):
    rows = clean.within(t.pitches, _FACET_X)
    return additive.smooth_band(rows, "hit_angle", "px", ["stand"])


# The sums that the smooth of each facet is solved from: four pieces are above zero at a time.
@query("t6_facet_cross_products", """
WITH kept AS (SELECT stand, px, hit_angle AS y FROM pitches WHERE px BETWEEN -1.5 AND 1.5 AND hit_angle BETWEEN -80 AND 80 AND hit_speed >= 90),
 cut AS (SELECT stand, y, (px + 1.5) / (3e0 / 5) AS u, least(floor((px + 1.5) / (3e0 / 5)), 4) AS k FROM kept),
 pieces AS (SELECT stand, y, CAST(k AS INTEGER) AS k,
  [pow(1 - (u - k), 3) / 6, (3 * pow(u - k, 3) - 6 * pow(u - k, 2) + 4) / 6, (3 * pow(1 - (u - k), 3) - 6 * pow(1 - (u - k), 2) + 4) / 6, pow(u - k, 3) / 6] AS b FROM cut),
 cells AS (SELECT stand, k + i AS i, k + j AS j, sum(b[i + 1] * b[j + 1]) AS value FROM pieces, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)
  WHERE i <= j GROUP BY ALL),
 sides AS (SELECT stand, k + i AS i, sum(b[i + 1] * y) AS value FROM pieces, (SELECT unnest(range(4)) AS i) GROUP BY ALL)
SELECT stand, CAST(i * 8 - i * (i - 1) // 2 + j - i AS INTEGER) AS place, round(value, 6) AS value FROM cells
UNION ALL SELECT stand, CAST(36 + i AS INTEGER), round(value, 6) FROM sides
UNION ALL SELECT stand, 44, round(sum(y * y), 6) FROM kept GROUP BY stand
UNION ALL SELECT stand, 45, CAST(count(*) AS DOUBLE) FROM kept GROUP BY stand""")
def _(t):
    rows = clean.within(t.pitches, _FACET_X)
    design = additive.Design((additive.Smooth("px", -1.5, 1.5, 5),), constant=False)
    sums = additive.cross_products(design.read(rows, "hit_angle", ["stand"]), design, ["stand"])
    return rounded(sums.filter((F.col("value") != 0) & (F.col("place") < 46)), "value")


@query("t7_box_summary", f"""
WITH {ZONED},
 q AS (SELECT stand, location, CAST(count(*) AS BIGINT) AS n, quantile_cont(hit_angle, 0.25) AS q1,
  quantile_cont(hit_angle, 0.5) AS median, quantile_cont(hit_angle, 0.75) AS q3 FROM zoned
  WHERE location <> 'Out of Zone' GROUP BY ALL)
SELECT q.stand, q.location, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 min(hit_angle) AS whisker_low, max(hit_angle) AS whisker_high, CAST(min(n) - count(*) AS BIGINT) AS outliers
FROM q JOIN zoned z ON q.stand = z.stand AND q.location = z.location
 AND hit_angle BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def _(t):
    rows = _zoned(t).filter(F.col("location") != S.OUT_OF_ZONE)
    return rounded(stats.box_summary(rows, "hit_angle", ["stand", "location"]), "q1", "median", "q3")


@query("t7_box_summary_distance", """
WITH q AS (SELECT stand, CAST(count(*) AS BIGINT) AS n, quantile_cont(hit_distance_sc, 0.25) AS q1,
  quantile_cont(hit_distance_sc, 0.5) AS median, quantile_cont(hit_distance_sc, 0.75) AS q3 FROM pitches GROUP BY ALL)
SELECT q.stand, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 min(hit_distance_sc) AS whisker_low, max(hit_distance_sc) AS whisker_high,
 CAST(min(n) - count(*) AS BIGINT) AS outliers
FROM q JOIN pitches z ON q.stand = z.stand
 AND hit_distance_sc BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def _(t):
    return rounded(stats.box_summary(t.pitches, "hit_distance_sc", ["stand"]), "q1", "median", "q3")


@query("t8_heat_grid", """
SELECT round_even(hit_angle, 0) AS hit_angle, round_even(hit_speed, 0) AS hit_speed, CAST(count(*) AS BIGINT) AS n,
 round(avg(p), 6) AS predicted_probability FROM labelled
WHERE hit_angle IS NOT NULL AND hit_speed IS NOT NULL AND fielding_team IS NOT NULL GROUP BY 1, 2""")
def _(t):
    columns = ["hit_angle", "hit_speed", "stand", "fielding_team", "home_team", "p"]
    grid = reports.detail_grid(clean.complete_cases(t.labelled.select(*columns)))
    return rounded(grid, "predicted_probability")


@query("t9_grouped_bars", """
SELECT velocity_range, round(avg(hit_angle) FILTER (stand = 'L'), 6) AS "Left Handed Batter",
 round(avg(hit_angle) FILTER (stand = 'R'), 6) AS "Right Handed Batter" FROM pitches
WHERE pz BETWEEN 1 AND 5 AND hit_angle BETWEEN -80 AND 80 AND hit_speed >= 90 GROUP BY velocity_range""")
def _(t):
    rows = clean.within(t.pitches, {"pz": (1, 5), "hit_angle": (-80, 80), "hit_speed": (90, None)})
    means = reports.group_mean(rows, "hit_angle", ["stand_label", "velocity_range"])
    sides = list(S.STAND_LABELS.values())
    bars = stats.grouped_bars(means, "velocity_range", "stand_label", sides, "mean")
    return bars.select("velocity_range", *[r6(F.col(f"`{s}`")).alias(s) for s in sides])


_EXTRACT = """kept AS (SELECT row_key, px, hit_angle, stand FROM pitches
 WHERE px BETWEEN -1.5 AND 1.5 AND hit_angle BETWEEN -80 AND 80 AND hit_speed >= 90)"""
_EXTRACT_RANGES = {"px": (-1.5, 1.5), "hit_angle": (-80, 80), "hit_speed": (90, None)}


@query("t10_scatter_extract", f"""
WITH {_EXTRACT},
 r AS (SELECT kept.*, row_number() OVER (ORDER BY md5('42|' || row_key)) AS rk, count(*) OVER () AS n FROM kept)
SELECT row_key, px, hit_angle, stand FROM r WHERE rk <= round_even(0.25 * n, 0)""")
def _(t):
    return reports.scatter_extract(t.pitches, "px", "hit_angle", ["stand"], _EXTRACT_RANGES)


@query("t10_scatter_extract_by_side", f"""
WITH {_EXTRACT},
 r AS (SELECT kept.*, row_number() OVER (PARTITION BY stand ORDER BY md5('42|' || row_key)) AS rk,
  count(*) OVER (PARTITION BY stand) AS n FROM kept)
SELECT row_key, px, hit_angle, stand FROM r WHERE rk <= round_even(0.25 * n, 0)""")
def _(t):
    return reports.scatter_extract(
        t.pitches, "px", "hit_angle", ["stand"], _EXTRACT_RANGES, within_facet="stand")


@query("t11_spray_extract", """
SELECT row_key, hc_x AS x, -hc_y AS y, CASE WHEN hit = 1 THEN 'Hit' ELSE 'Out' END AS hit_label,
 CASE WHEN hit <> fit THEN 'Incorrect' ELSE 'Correct' END AS miss
FROM scored WHERE hc_x BETWEEN 0 AND 250 AND -hc_y BETWEEN -250 AND 0""")
def _(t):
    return reports.spray_extract(t.scored)
