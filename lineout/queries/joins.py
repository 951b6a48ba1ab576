"""Joins, set operations and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineout.operators import joins, reports, sampling
from lineout.queries.derived import ANGLE_BIN, SPEED_BIN, _ZONE_CASE
from lineout.queries.registry import query, rounded
from lineout.sources import read

_HEIGHTS = """heights AS (SELECT batter, b_height FROM (
 SELECT batter, b_height, row_number() OVER (PARTITION BY batter ORDER BY game_date DESC, b_height DESC) AS rn
 FROM balls WHERE year(game_date) > 1996) WHERE rn = 1)"""


def _heights(t):
    return read.latest_per_key(t.balls, "batter", "b_height", "game_date", after_season=1996)


@query("j1_lookup_join", f"""
WITH {_HEIGHTS}
SELECT row_key, balls.batter, heights.b_height FROM balls LEFT JOIN heights ON balls.batter = heights.batter""")
def _(t):
    return joins.lookup_join(t.balls.select("row_key", "batter"), _heights(t), "batter")


@query("j1_lookup_join_salted", f"""
WITH {_HEIGHTS}
SELECT row_key, balls.batter, heights.b_height FROM balls LEFT JOIN heights ON balls.batter = heights.batter""")
def _(t):
    return joins.lookup_join(t.balls.select("row_key", "batter"), _heights(t), "batter", salts=8)


_BUCKETS = f"""predicted AS (SELECT angle_bin, speed_bin, avg(p) AS ave_prob FROM
  (SELECT p, {ANGLE_BIN} AS angle_bin, {SPEED_BIN} AS speed_bin FROM scored WHERE split <> 'train') GROUP BY ALL),
 observed AS (SELECT angle_bin, speed_bin, count(*) AS n, avg(hit) AS empirical_ave FROM
  (SELECT hit, {ANGLE_BIN} AS angle_bin, {SPEED_BIN} AS speed_bin FROM labelled WHERE hc_x <> 1) GROUP BY ALL)"""


@query("j2_bucket_join", f"""
WITH {_BUCKETS}
SELECT a.angle_bin, a.speed_bin, round(ave_prob, 6) AS ave_prob, CAST(n AS BIGINT) AS n,
 round(empirical_ave, 6) AS empirical_ave
FROM predicted a LEFT JOIN observed b
 ON a.angle_bin IS NOT DISTINCT FROM b.angle_bin AND a.speed_bin IS NOT DISTINCT FROM b.speed_bin""")
def _(t):
    # The observed side keeps rows without measures, so missing buckets meet missing buckets.
    predicted = reports.predicted_by_bucket(sampling.out_of_training(t.split))
    observed = reports.empirical_by_bucket(t.labelled.filter(F.col("hc_x") != 1))
    return rounded(reports.compare_buckets(predicted, observed), "ave_prob", "empirical_ave")


@query("j3_restore_columns", """
SELECT row_key, hit, hit_speed, hit_angle FROM clean""")
def _(t):
    scaled = t.clean.select("row_key", "hit", (F.col("hit_speed") / 10).alias("hit_speed"), "hit_angle")
    return joins.restore_columns(scaled, t.clean, ["hit_speed", "hit_angle"])


@query("j4_keep_keys", """
SELECT row_key, hit_speed FROM balls WHERE row_key IN (SELECT row_key FROM split WHERE split = 'test')""")
def _(t):
    test = t.split.filter(F.col("split") == "test")
    return joins.keep_keys(t.balls.select("row_key", "hit_speed"), test)


@query("j5_zone_range_join", f"""
SELECT stand, CASE {_ZONE_CASE} ELSE 'Out of Zone' END AS location, CAST(count(*) AS BIGINT) AS n
FROM balls GROUP BY ALL""")
def _(t):
    zoned = joins.zone_code(t.balls.select("stand", "px", "pz"), joins.default_zones(t.spark))
    return zoned.groupBy("stand", "location").agg(F.count(F.lit(1)).alias("n"))


@query("u1_set_difference", """
SELECT row_key, hit_speed, split FROM split WHERE split <> 'train'""")
def _(t):
    labelled = t.split.select("row_key", "hit_speed", "split")
    return joins.drop_keys(labelled, labelled.filter(F.col("split") == "train"))


@query("u1_subtract_rows", """
SELECT stand, balls, strikes FROM balls EXCEPT SELECT stand, balls, strikes FROM balls WHERE hit_speed > 100""")
def _(t):
    columns = t.balls.select("stand", "balls", "strikes", "hit_speed")
    return columns.drop("hit_speed").subtract(columns.filter(F.col("hit_speed") > 100).drop("hit_speed"))


@query("u2_append", """
SELECT row_key, stand, hit FROM labelled WHERE stand = 'L' UNION ALL
SELECT row_key, stand, hit FROM labelled WHERE hit = 1""")
def _(t):
    left = t.labelled.filter(F.col("stand") == "L").select("row_key", "stand", "hit")
    right = t.labelled.filter(F.col("hit") == 1).select("hit", "row_key", "stand")
    return joins.append(left, right)


@query("o1_sort_descending", "SELECT row_key, hit FROM clean ORDER BY hit DESC NULLS LAST, row_key")
def _(t):
    return t.clean.select("row_key", "hit").orderBy(F.desc_nulls_last("hit"), "row_key")  # the second key lets a sort spread two values


@query("o2_sort_by_bin", f"""
WITH {_BUCKETS}
SELECT angle_bin, speed_bin, round(ave_prob, 6) AS ave_prob FROM predicted
ORDER BY speed_bin DESC NULLS LAST, angle_bin DESC NULLS LAST""")
def _(t):
    table = reports.predicted_by_bucket(sampling.out_of_training(t.split))
    return rounded(table, "ave_prob").orderBy(F.desc_nulls_last("speed_bin"), F.desc_nulls_last("angle_bin"))


@query("o3_sort_by_label", f"""
WITH {_BUCKETS}
SELECT CAST((angle_bin - 1) * 10 - 90 AS VARCHAR) || ' to ' || CAST(angle_bin * 10 - 90 AS VARCHAR)
  AS "Launch Angle Range (degrees)",
 CAST((speed_bin - 1) * 10 AS VARCHAR) || ' to ' || CAST(speed_bin * 10 AS VARCHAR) AS "Exit Velocity Range (mph)",
 printf('%.1f%%', round_even(ave_prob, 3) * 100) AS "Predicted Probability of a Hit"
FROM predicted ORDER BY 1, 2""")
def _(t):
    table = reports.predicted_by_bucket(sampling.out_of_training(t.split))
    return reports.bucket_display(table, order="label")
