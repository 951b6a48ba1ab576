"""Projection, filters and record identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineout import schema as S
from lineout.functions import labels as L
from lineout.operators import clean, models
from lineout.queries.registry import query
from lineout.sources.write import materialise


@query("p1_project", "SELECT row_key, hit_angle, hit_speed, p FROM balls")
def _(t):
    return t.balls.select("row_key", "hit_angle", "hit_speed", "p")


@query("p2_column_range", "SELECT row_key, hit_distance_sc, hit_speed, hit_angle FROM balls")
def _(t):
    return t.balls.select("row_key", *clean.column_range(t.balls, "hit_distance_sc", "hit_angle"))


@query("p3_drop_columns", """
SELECT row_key, hit, stand, fielding_team FROM
 (SELECT row_key, hit, stand, fielding_team, home_team, hc_x FROM labelled)""")
def _(t):
    kept = t.labelled.select("row_key", "hit", "stand", "fielding_team", "home_team", "hc_x")
    return kept.drop("home_team", "hc_x")


@query("p4_by_position", "SELECT row_key, batter, hit_speed AS fits FROM (SELECT row_key, batter, hit_speed FROM balls)")
def _(t):
    df = t.balls.select("row_key", "batter", "hit_speed")
    return df.withColumnRenamed(df.columns[2], "fits")


@query("p5_display_names", """
SELECT row_key AS "Record", hit_angle AS "Launch Angle (degrees)", hit_speed AS "Exit Velocity (mph)" FROM balls""")
def _(t):
    return t.balls.select("row_key", "hit_angle", "hit_speed").toDF(
        "Record", "Launch Angle (degrees)", "Exit Velocity (mph)")


@query("p6_add_columns", """
SELECT row_key, CAST(year(game_date) AS INTEGER) AS season, CAST(fit AS INTEGER) AS fit_dummy FROM scored""")
def _(t):
    return t.scored.withColumns({"season": L.season(F.col("game_date")), "fit_dummy": F.col("fit")}).select(
        "row_key", "season", "fit_dummy")


@query("p7_bind_predictions", "SELECT row_key, stand, hit, p FROM clean")
def _(t):
    rows = materialise(t.once.clean.select("row_key", "stand", "hit", "p"))  # read twice
    return rows.select("row_key", "stand", "hit").join(rows.select("row_key", "p"), "row_key")


@query("p9_row_key", """
SELECT row_key, md5(concat_ws('|', CAST(batter AS VARCHAR), CAST(game_date AS VARCHAR),
 coalesce(events, '\\N'), coalesce(inning_topbot, '\\N'), home_team, CAST(balls AS VARCHAR))) AS record FROM balls""")
def _(t):
    columns = ("batter", "game_date", "events", "inning_topbot", "home_team", "balls")
    return clean.with_row_key(t.balls, columns, "record").select("row_key", "record")


@query("p10_require_measures", """
SELECT row_key FROM balls WHERE hit_distance_sc IS NOT NULL AND hit_angle IS NOT NULL AND hit_speed IS NOT NULL""")
def _(t):
    return clean.complete_cases(t.balls, S.REQUIRED_MEASURES).select("row_key")


@query("p11_complete_cases", """
SELECT row_key, hit_angle, hit_speed, stand, fielding_team, home_team FROM labelled
WHERE hit_angle IS NOT NULL AND hit_speed IS NOT NULL AND fielding_team IS NOT NULL""")
def _(t):
    return clean.complete_cases(
        t.labelled.select("row_key", "hit_angle", "hit_speed", "stand", "fielding_team", "home_team"))


@query("p12_drop_miscoded", "SELECT row_key, hc_x, hc_y FROM balls WHERE hc_x <> 1 AND hc_y <> 1")
def _(t):
    return clean.drop_miscoded(t.balls).select("row_key", "hc_x", "hc_y")


@query("p13_until_date", "SELECT row_key, game_date FROM balls WHERE game_date <= DATE '1996-05-28'")
def _(t):
    return clean.until(t.balls, "1996-05-28").select("row_key", "game_date")


@query("p14_within_ranges", """
SELECT row_key, px, pz, hit_angle, hit_speed FROM balls WHERE px BETWEEN -1.5 AND 1.5 AND pz BETWEEN 1 AND 4
 AND hit_angle BETWEEN -80 AND 80 AND hit_speed >= 90""")
def _(t):
    ranges = {"px": (-1.5, 1.5), "pz": (1, 4), "hit_angle": (-80, 80), "hit_speed": (90, None)}
    return clean.within(t.balls, ranges).select("row_key", "px", "pz", "hit_angle", "hit_speed")


@query("p15_exclude_values", """
SELECT row_key, events FROM balls WHERE events IS NULL OR events NOT IN
 ('Bunt Lineout', 'Sac Bunt', 'Bunt Pop Out', 'Sacrifice Bunt DP', 'Bunt Groundout')""")
def _(t):
    return clean.exclude(t.balls, "events", S.BUNT_EVENTS).select("row_key", "events")


@query("p16_text_inequality", "SELECT row_key, events FROM balls WHERE events <> 'Home Run'")
def _(t):
    return t.balls.filter(F.col("events") != "Home Run").select("row_key", "events")


@query("p17_class_subset", """
SELECT row_key, hit_type, CAST(dense_rank() OVER (ORDER BY hit_type) - 1 AS INTEGER) AS class_index
FROM clean WHERE hit_type <> 0""")
def _(t):
    hits = models.only_hits(t.clean).select("row_key", "hit_type")
    return models.index_classes("hit_type").fit(hits).transform(hits).select(
        "row_key", "hit_type", F.col("_label").cast("int").alias("class_index"))
