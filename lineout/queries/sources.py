"""Reading, cleaning text, per-key functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineout.operators import clean, joins
from lineout.queries.registry import query
from lineout.sources import read

SEASON = 1996


@query("s2_season_batters", f"""
SELECT DISTINCT batter, CAST({SEASON} AS INTEGER) AS year FROM balls
WHERE year(game_date) = {SEASON} AND lower(des2) LIKE 'in play%'""")
def _(t):
    return read.season_batters(t.balls, SEASON)


@query("s3_balls_in_play", "SELECT batter, row_key, type, hit_speed FROM balls WHERE type = 'X' ORDER BY batter")
def _(t):
    return read.balls_in_play(t.balls, ordered=True).select("batter", "row_key", "type", "hit_speed")


@query("s4_latest_per_key", """
SELECT batter, b_height FROM (
 SELECT batter, b_height, row_number() OVER (PARTITION BY batter ORDER BY game_date DESC, b_height DESC) AS rn
 FROM balls WHERE type = 'X' AND year(game_date) > 1994) WHERE rn = 1""")
def _(t):
    return read.latest_per_key(read.balls_in_play(t.balls), "batter", "b_height", "game_date", after_season=1994)


@query("s6_table_function_per_key", """
SELECT batter, year, CAST(q AS INTEGER) AS quarter,
 year || '/' || batter || '-q' || q || '.csv' AS extract
FROM (SELECT DISTINCT batter, year FROM balls), (SELECT unnest([1, 2, 3, 4]) AS q)""")
def _(t):
    # Defined here so that it travels to the workers by value.
    def quarters(batter: int, year: int) -> dict[str, list]:
        quarter = list(range(1, 5))
        return {
            "batter": [batter] * 4, "year": [year] * 4, "quarter": quarter,
            "extract": [f"{year}/{batter}-q{q}.csv" for q in quarter],
        }

    keys = t.once.balls.select("batter", "year")
    return joins.apply_per_key(keys, quarters, "batter long, year int, quarter int, extract string")


_TEXT = ("events", "inning_topbot", "pitch_type")


@query("s7_blank_sentinel", "SELECT row_key, events, inning_topbot, pitch_type FROM balls")
def _(t):
    raw = t.balls.select("row_key", *[F.coalesce(c, F.lit("null")).alias(c) for c in _TEXT])
    return clean.blank_sentinel(raw)


@query("s8_safe_cast", """
SELECT row_key, TRY_CAST(CASE WHEN balls = 3 THEN 'abc' ELSE CAST(hit_speed AS VARCHAR) END AS DOUBLE) AS hit_speed,
 TRY_CAST(CASE WHEN balls = 2 THEN 'abc' ELSE CAST(batter AS VARCHAR) END AS DOUBLE) AS batter FROM balls""")
def _(t):
    def text(c, balls):
        return F.when(F.col("balls") == balls, "abc").otherwise(F.col(c).cast("string")).alias(c)

    return clean.to_numbers(t.balls.select("row_key", text("hit_speed", 3), text("batter", 2)), ["hit_speed", "batter"])
