"""Aggregations and report tables."""

from __future__ import annotations



from lineout.operators import clean, features, joins, reports, sampling
from lineout.queries.derived import ANGLE_BIN, DISTANCE_BIN, SPEED_BIN, ZONED
from lineout.queries.registry import query, rounded

_FRAME = {"hit_angle": (-80, 80), "hit_speed": (90, None)}
_FRAME_SQL = "hit_angle BETWEEN -80 AND 80 AND hit_speed >= 90"


def _zoned(t):
    return joins.zone_code(t.pitches, joins.default_zones(t.spark))


@query("a1_group_mean", f"""
SELECT stand_label, round(avg(hit_angle), 6) AS mean FROM pitches
WHERE px BETWEEN -1.5 AND 1.5 AND {_FRAME_SQL} GROUP BY ALL""")
def _(t):
    rows = clean.within(t.pitches, {"px": (-1.5, 1.5), **_FRAME})
    return rounded(reports.group_mean(rows, "hit_angle", ["stand_label"]), "mean")


@query("a2_rounded_mean", f"""
SELECT stand_label, round(avg(hit_angle), 1) AS mean FROM pitches
WHERE pz BETWEEN 1 AND 4 AND {_FRAME_SQL} GROUP BY ALL""")
def _(t):
    rows = clean.within(t.pitches, {"pz": (1, 4), **_FRAME})
    return reports.group_mean(rows, "hit_angle", ["stand_label"], digits=1)


@query("a3_mean_by_velocity", f"""
SELECT stand_label, velocity_range, round(avg(hit_angle), 6) AS average_launch_angle FROM pitches
WHERE pz BETWEEN 1 AND 5 AND {_FRAME_SQL} GROUP BY ALL""")
def _(t):
    rows = clean.within(t.pitches, {"pz": (1, 5), **_FRAME})
    table = reports.group_mean(rows, "hit_angle", ["stand_label", "velocity_range"], "average_launch_angle")
    return rounded(table, "average_launch_angle")


@query("a3_mean_by_location", f"""
WITH {ZONED}
SELECT stand_label, location, round(avg(hit_angle), 6) AS average_launch_angle FROM zoned
WHERE pz BETWEEN 1 AND 4 AND {_FRAME_SQL} GROUP BY ALL""")
def _(t):
    rows = clean.within(_zoned(t), {"pz": (1, 4), **_FRAME})
    table = reports.group_mean(rows, "hit_angle", ["stand_label", "location"], "average_launch_angle")
    return rounded(table, "average_launch_angle")


@query("a3_mean_by_count", f"""
SELECT stand_label, "count", round(avg(hit_angle), 6) AS average_launch_angle FROM pitches
WHERE px BETWEEN -1.5 AND 1.5 AND {_FRAME_SQL} GROUP BY ALL""")
def _(t):
    rows = clean.within(t.pitches, {"px": (-1.5, 1.5), **_FRAME})
    table = reports.group_mean(rows, "hit_angle", ["stand_label", "count"], "average_launch_angle")
    return rounded(table, "average_launch_angle")


@query("a4_predicted_by_bucket", f"""
SELECT {ANGLE_BIN} AS angle_bin, {SPEED_BIN} AS speed_bin, round(avg(p), 6) AS ave_prob FROM scored GROUP BY ALL""")
def _(t):
    return rounded(reports.predicted_by_bucket(t.scored), "ave_prob")


@query("a5_empirical_by_bucket", f"""
SELECT {ANGLE_BIN} AS angle_bin, {SPEED_BIN} AS speed_bin, CAST(count(*) AS BIGINT) AS n,
 round(avg(hit), 6) AS empirical_ave FROM clean GROUP BY ALL""")
def _(t):
    return rounded(reports.empirical_by_bucket(t.clean), "empirical_ave")


@query("a6_means_and_counts", """
SELECT hit, balls, round(avg(hit_distance_sc), 6) AS hit_distance_sc_mean, CAST(count(*) AS BIGINT) AS hit_distance_sc_n,
 round(avg(hit_angle), 6) AS hit_angle_mean, CAST(count(*) AS BIGINT) AS hit_angle_n,
 round(avg(hit_speed), 6) AS hit_speed_mean, CAST(count(*) AS BIGINT) AS hit_speed_n FROM labelled GROUP BY ALL""")
def _(t):
    table = reports.means_and_counts(t.labelled, ["hit_distance_sc", "hit_angle", "hit_speed"], ["hit", "balls"])
    return rounded(table, "hit_distance_sc_mean", "hit_angle_mean", "hit_speed_mean")


@query("a7_team_conversion", """
WITH flags AS (SELECT fielding_team, fit, CAST(fit = 0 AS INTEGER) AS eo, CAST(fit = 0 AND hit = 0 AS INTEGER) AS eom,
 CAST(fit <> 0 AND hit = 0 AS INTEGER) AS uom FROM scored WHERE fit IS NOT NULL)
SELECT fielding_team, CAST(sum(eo) AS BIGINT) AS expected_outs_total, CAST(sum(eom) AS BIGINT) AS expected_outs_converted,
 CAST(sum(uom) AS BIGINT) AS unexpected_outs_converted, CAST(sum(fit) AS BIGINT) AS expected_hits_total,
 round(sum(eom) / nullif(sum(eo), 0), 6) AS expected_outs_perc,
 round(sum(uom) / nullif(sum(fit), 0), 6) AS unexpected_outs_perc FROM flags GROUP BY fielding_team""")
def _(t):
    return rounded(reports.conversion_by_team(t.scored), "expected_outs_perc", "unexpected_outs_perc")


@query("a8_team_average", """
SELECT fielding_team, CAST(count(*) AS BIGINT) AS n, round(sum(fit) / count(*), 6) AS expected_ba,
 round(sum(hit) / count(*), 6) AS actual_ba FROM scored WHERE fit IS NOT NULL AND events <> 'Home Run'
GROUP BY fielding_team""")
def _(t):
    return rounded(reports.average_by_team(t.scored), "expected_ba", "actual_ba")


@query("a9_overall_average", """
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(hit) / nullif(count(*), 0), 6) AS actual_ba
FROM scored WHERE events <> 'Home Run'""")
def _(t):
    return rounded(reports.overall_average(t.scored), "actual_ba")


@query("a10_frequency", "SELECT events, CAST(count(*) AS BIGINT) AS n FROM balls WHERE events IS NOT NULL GROUP BY ALL")
def _(t):
    return reports.frequency(t.balls, "events")


@query("a11_class_shares", """
SELECT hit_type, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM clean GROUP BY hit_type""")
def _(t):
    return rounded(reports.class_shares(t.clean, "hit_type"), "share")


@query("a11_class_shares_by_split", """
SELECT split, hit, CAST(count(*) AS BIGINT) AS n,
 round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM split GROUP BY split, hit""")
def _(t):
    return rounded(reports.class_shares(t.split, "hit", ["split"]), "share")


@query("a12_contingency", """
SELECT hit_type, stand, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY ALL""")
def _(t):
    return reports.contingency(t.labelled, "hit_type", "stand")


@query("a13_detail_grid", """
SELECT round_even(hit_angle, 0) AS hit_angle, round_even(hit_speed, 0) AS hit_speed, CAST(count(*) AS BIGINT) AS n,
 round(avg(p), 6) AS predicted_probability FROM scored GROUP BY 1, 2""")
def _(t):
    return rounded(reports.detail_grid(t.scored), "predicted_probability")


@query("a14_accuracy_by_distance", f"""
SELECT CAST({DISTANCE_BIN} AS INTEGER) AS distance_bin, CAST(count(*) AS BIGINT) AS n,
 round(avg(CAST(hit = fit AS INTEGER)), 6) AS correct_perc
FROM (SELECT *, hit_distance_sc AS d FROM scored) GROUP BY 1""")
def _(t):
    table = reports.accuracy_by_distance(t.scored).drop("distance_label")
    return rounded(table, "correct_perc")


@query("a15_split_sizes", """
SELECT split, CAST(count(*) AS BIGINT) AS n, (SELECT CAST(count(*) AS BIGINT) FROM clean) AS total
FROM split GROUP BY split""")
def _(t):
    return sampling.split_sizes(t.split)


@query("a16_distinct_keys", "SELECT DISTINCT batter FROM balls")
def _(t):
    return t.balls.select("batter").distinct()


@query("a17_mean_and_sd", """
SELECT feature, round(avg(v), 6) AS center, round(stddev_samp(v), 6) AS scale FROM (
 SELECT 'hit_distance_sc' AS feature, hit_distance_sc AS v FROM clean UNION ALL SELECT 'hit_speed', hit_speed FROM clean
 UNION ALL SELECT 'hit_angle', hit_angle FROM clean UNION ALL SELECT 'hc_x', hc_x FROM clean
 UNION ALL SELECT 'hc_y', hc_y FROM clean) GROUP BY feature""")
def _(t):
    return rounded(features.scale_table(t.clean), "center", "scale")


@query("a18_expected_run_value", """
SELECT fielding_team, CAST(count(*) AS BIGINT) AS n, round(sum(run_value), 6) AS total, round(avg(run_value), 6) AS mean
FROM labelled GROUP BY fielding_team""")
def _(t):
    return rounded(reports.expected_run_value(t.labelled, ["fielding_team"]), "total", "mean")
