"""A batted-ball table projected from the test tables, and stages built on it.

The projection is one SQL text that both engines run. Everything after it is
written twice: with this package's operators, and as SQL in ``PRELUDE``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.functions import labels as L
from lineout.operators import clean, sampling
from lineout.sources.write import materialise

SOURCES = ("lineitem", "orders", "supplier", "nation", "customer")

PROJECTION = """
WITH base AS (
 SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',CAST(l_shipdate AS DATE)) AS row_key,
  o_custkey AS batter, CAST(year(l_shipdate) AS INT) AS year, CAST(l_shipdate AS DATE) AS game_date,
  CASE WHEN l_linenumber=7 AND l_returnflag='N' THEN NULL ELSE 20+2*l_quantity END AS hit_speed,
  CASE WHEN l_linenumber=7 AND l_returnflag='A' THEN NULL ELSE CAST(l_partkey%181 AS DOUBLE)-90 END AS hit_angle,
  CASE WHEN l_linenumber=7 AND l_returnflag='R' THEN NULL ELSE l_extendedprice/200 END AS hit_distance_sc,
  CASE WHEN l_linenumber=6 AND l_linestatus='F' THEN 1e0 ELSE CAST(18+(l_suppkey*7+l_orderkey)%220 AS DOUBLE) END AS hc_x,
  CASE WHEN l_linenumber=6 AND l_returnflag='A' THEN 1e0 ELSE CAST(30+(l_partkey+l_orderkey)%200 AS DOUBLE) END AS hc_y,
  CASE WHEN l_orderkey%3=0 THEN 'L' ELSE 'R' END AS stand,
  sn.n_name AS home_team, cn.n_name AS away_team,
  CASE WHEN l_linenumber=5 AND l_linestatus='F' THEN NULL WHEN l_linestatus='F' THEN 'bot' ELSE 'top' END AS inning_topbot,
  CAST(l_orderkey%4 AS INT) AS balls, CAST(l_partkey%3 AS INT) AS strikes,
  CASE l_suppkey%8 WHEN 0 THEN 'FF' WHEN 1 THEN 'FC' WHEN 2 THEN 'SI' WHEN 3 THEN 'FT' WHEN 4 THEN 'CU'
    WHEN 5 THEN 'SL' WHEN 6 THEN 'CH' ELSE NULL END AS pitch_type,
  CASE WHEN l_linenumber=3 AND l_returnflag='A' THEN NULL ELSE 70+(l_orderkey%70)/2e0 END AS start_speed,
  (l_partkey%401-200)/100e0 AS px, (l_orderkey%601)/100e0 AS pz,
  CAST(1500+(l_suppkey*37+l_partkey)%1500 AS DOUBLE) AS release_spin_rate,
  CAST(66+o_custkey%14 AS DOUBLE) AS b_height,
  CASE WHEN l_linenumber=1 AND l_returnflag='N' THEN 'S' ELSE 'X' END AS type,
  CASE WHEN l_linenumber=1 AND l_returnflag='N' THEN 'Foul'
    WHEN l_linestatus='F' THEN 'In play, out(s)' ELSE 'In play, no out' END AS des2,
  o_orderpriority AS prio, l_returnflag AS rf, l_linenumber AS ln, l_tax
 FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey
  JOIN {supplier} ON l_suppkey=s_suppkey JOIN {nation} sn ON s_nationkey=sn.n_nationkey
  JOIN {customer} ON o_custkey=c_custkey JOIN {nation} cn ON c_nationkey=cn.n_nationkey),
batted_ball AS (
 SELECT base.*, CASE WHEN ln=4 AND rf='A' AND l_tax=0 THEN NULL
  WHEN prio='3-MEDIUM' AND rf<>'R' THEN 'Groundout'
  WHEN hit_angle BETWEEN 20 AND 40 AND hit_speed>=95 THEN 'Home Run'
  WHEN hit_angle BETWEEN 0 AND 30 AND hit_speed>=80 AND prio='1-URGENT' THEN 'Triple'
  WHEN hit_angle BETWEEN 0 AND 30 AND hit_speed>=70 THEN 'Double'
  WHEN hit_angle BETWEEN -20 AND 45 AND hit_speed>=40 THEN 'Single'
  WHEN prio='2-HIGH' AND rf='R' THEN 'Single'
  WHEN ln=2 AND prio='5-LOW' THEN 'Bunt Groundout' ELSE 'Groundout' END AS events
 FROM base)
SELECT row_key, batter, year, game_date, events, des2, type, inning_topbot, home_team, away_team, stand, balls, strikes,
  pitch_type, start_speed, release_spin_rate, px, pz, hit_distance_sc, hit_speed, hit_angle, hc_x, hc_y, b_height,
  CASE WHEN hit_speed IS NULL OR hit_angle IS NULL THEN NULL
  ELSE floor(501*least(1e0,greatest(0e0,0.65e0+(hit_speed-70)/200e0-abs(hit_angle-12)/120e0)))/501e0 END AS p
FROM batted_ball
"""

# The same stages in SQL: balls, labelled, clean, split, scored.
PRELUDE = (
    "WITH balls AS (" + PROJECTION.format(**{t: t for t in SOURCES}) + """),
labelled AS (
 SELECT balls.*,
  CAST(CASE WHEN events LIKE '%Single%' OR events LIKE '%Double%' OR events LIKE '%Triple%'
    OR events LIKE '%Home Run%' THEN 1 ELSE 0 END AS INTEGER) AS hit,
  CAST(CASE WHEN events LIKE '%Single%' THEN 1 WHEN events LIKE '%Double%' THEN 2 WHEN events LIKE '%Triple%' THEN 3
    WHEN events LIKE '%Home Run%' THEN 4 ELSE 0 END AS INTEGER) AS hit_type,
  CAST(CASE WHEN events LIKE '%Single%' THEN 0.462 WHEN events LIKE '%Double%' THEN 0.762
    WHEN events LIKE '%Triple%' THEN 1.03 WHEN events LIKE '%Home Run%' THEN 1.4 ELSE 0 END AS DOUBLE) AS run_value,
  CASE WHEN inning_topbot IS NULL THEN NULL WHEN inning_topbot = 'bot' THEN away_team ELSE home_team END AS fielding_team,
  CAST(balls AS VARCHAR) || '-' || CAST(strikes AS VARCHAR) AS "count",
  CASE WHEN pitch_type IN ('FF','FC','SI','FT','FA','FO') THEN 'Fastballs' ELSE 'Other' END AS pitch_category,
  CASE WHEN start_speed IS NULL THEN NULL WHEN start_speed <= 75 THEN 'Less than 75 mph'
    WHEN start_speed <= 80 THEN '75 to 80 mph' WHEN start_speed <= 85 THEN '80 to 85 mph'
    WHEN start_speed <= 90 THEN '85 to 90 mph' WHEN start_speed <= 95 THEN '90 to 95 mph'
    WHEN start_speed <= 100 THEN '95 to 100 mph' ELSE '> 100 mph' END AS velocity_range,
  CASE stand WHEN 'R' THEN 'Right Handed Batter' WHEN 'L' THEN 'Left Handed Batter' END AS stand_label
 FROM balls),
clean AS (
 SELECT * FROM labelled WHERE hit_distance_sc IS NOT NULL AND hit_angle IS NOT NULL AND hit_speed IS NOT NULL
  AND hc_x <> 1 AND hc_y <> 1),
ranked AS (
 SELECT clean.*, row_number() OVER (ORDER BY md5('42|' || row_key)) AS rk, count(*) OVER () AS total FROM clean),
split AS (
 SELECT ranked.* EXCLUDE (rk, total), CASE WHEN rk <= round_even(0.15 * total, 0) THEN 'train'
  WHEN rk <= round_even(0.15 * total, 0) + round_even(0.5 * (total - round_even(0.15 * total, 0)), 0) THEN 'test'
  ELSE 'validate' END AS split FROM ranked),
scored AS (SELECT split.*, CAST(p > 0.5 AS INTEGER) AS fit FROM split),
pitches AS (
 SELECT * FROM labelled WHERE hit_distance_sc IS NOT NULL AND hit_angle IS NOT NULL AND hit_speed IS NOT NULL
  AND (events IS NULL OR events NOT IN
   ('Bunt Lineout', 'Sac Bunt', 'Bunt Pop Out', 'Sacrifice Bunt DP', 'Bunt Groundout')))
"""
)


# The joins as Spark runs them: orders meet their customers first, so line items move once, whatever the size of customer.
_JOINS = PROJECTION[PROJECTION.index(" FROM {lineitem}"):PROJECTION.index("),\nbatted_ball")]
_SPARK_PROJECTION = PROJECTION.replace(_JOINS, """ FROM {lineitem} JOIN {placed} cn ON l_orderkey=o_orderkey
  JOIN {supplier} ON l_suppkey=s_suppkey JOIN {nation} sn ON s_nationkey=sn.n_nationkey""")

_STORED: dict[tuple[str, str], DataFrame] = {}


def projected_balls(spark: SparkSession, folder: str) -> DataFrame:
    """The projected table, for a query that reads it once: joined as it is read, with the columns that are needed.

    Line items and orders meet in a merge join at every size, so that what moves grows with the input.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key in _STORED:
        return _STORED[key]
    frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in SOURCES}
    placed = (
        frames["orders"].join(frames["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(frames["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderpriority", "n_name")
    )
    return spark.sql(_SPARK_PROJECTION, placed=placed.hint("merge"), **{t: frames[t] for t in ("lineitem", "supplier", "nation")})


def stored_balls(spark: SparkSession, folder: str) -> DataFrame:
    """The projected table, joined and written once per session and folder.

    It stands for the batted-ball table a user has: queries read the columns
    they need from it instead of each repeating the joins.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        _STORED[key] = materialise(projected_balls(spark, folder))
    return _STORED[key]


class Tables:
    """The stages for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def balls(self) -> DataFrame:
        return stored_balls(self.spark, self.folder)

    @property
    def once(self) -> Tables:
        """The same stages for a query that reads the table once: nothing is written first."""
        tables = Tables(self.spark, self.folder)
        tables.balls = projected_balls(self.spark, self.folder)
        return tables

    @cached_property
    def labelled(self) -> DataFrame:
        return clean.with_pitch_labels(clean.with_outcomes(self.balls))

    @cached_property
    def clean(self) -> DataFrame:
        return clean.modelling_rows(self.labelled)

    @cached_property
    def scored(self) -> DataFrame:
        return self.clean.withColumn("fit", L.threshold(F.col("p"), F.lit(0.5)))

    @cached_property
    def split(self) -> DataFrame:
        """Scored rows with a split label, stored once for all that reads them."""
        return sampling.stored_three_way_split(self.once.scored.select(*S.MODEL_COLUMNS, "p", "fit"))

    @cached_property
    def pitches(self) -> DataFrame:
        """Rows of the launch-angle study: measured, and not bunts."""
        return clean.exclude(clean.complete_cases(self.labelled, S.REQUIRED_MEASURES), "events", S.BUNT_EVENTS)
