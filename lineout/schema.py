"""Declared schemas and the fixed values every other module reads.

Column types are declared, never inferred: raw extracts arrive as text, so the
reader uses ``RAW_SCHEMA`` and ``clean_extract`` casts to ``MEASURES`` / ``IDS``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of a raw extract; everything is text on read.
RAW_COLUMNS = (
    "batter", "year", "game_pk", "game_date", "events", "des2", "type",
    "inning_topbot", "home_team", "away_team", "stand", "balls", "strikes",
    "pitch_type", "start_speed", "release_spin_rate", "px", "pz",
    "on_1b", "on_2b", "on_3b", "hit_distance_sc", "hit_speed", "hit_angle",
    "hc_x", "hc_y",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
CORRUPT_COLUMN = "_corrupt_record"

IDS = ("batter", "game_pk", "on_1b", "on_2b", "on_3b")
SMALL_INTS = ("year", "balls", "strikes")
MEASURES = (
    "start_speed", "release_spin_rate", "px", "pz",
    "hit_distance_sc", "hit_speed", "hit_angle", "hc_x", "hc_y",
)
# The measures a modelling row must have.
REQUIRED_MEASURES = ("hit_distance_sc", "hit_angle", "hit_speed")
COORDINATES = ("hc_x", "hc_y")
SCALED = ("hit_distance_sc", "hit_speed", "hit_angle", "hc_x", "hc_y")
SCALED_WITH_ANGLE = SCALED + ("hor_angle",)
CATEGORIES = ("stand", "fielding_team", "home_team")
# What the models and their reports read; the rest of a wide row is left behind.
MODEL_COLUMNS = (
    "row_key", "game_date", "events", "hit", "hit_type", "run_value", *CATEGORIES, *SCALED_WITH_ANGLE,
)

# --- fixed values: these must equal the published ones for right results -----
HIT_WORDS = ("Single", "Double", "Triple", "Home Run")
RUN_VALUES = {1: 0.462, 2: 0.762, 3: 1.03, 4: 1.4}
FASTBALLS = ("FF", "FC", "SI", "FT", "FA", "FO")
BUNT_EVENTS = (
    "Bunt Lineout", "Sac Bunt", "Bunt Pop Out", "Sacrifice Bunt DP", "Bunt Groundout",
)
STAND_LABELS = {"R": "Right Handed Batter", "L": "Left Handed Batter"}
COUNT_LEVELS = (
    "3-0", "3-1", "2-0", "3-2", "1-0", "2-1", "0-0", "1-1", "2-2", "0-1", "1-2", "0-2",
)
VELOCITY_EDGES = (75, 80, 85, 90, 95, 100)
VELOCITY_LEVELS = (
    "Less than 75 mph", "75 to 80 mph", "80 to 85 mph", "85 to 90 mph",
    "90 to 95 mph", "95 to 100 mph", "> 100 mph",
)
ANGLE_BINS = (-90, 90, 10)   # low, high, width
SPEED_BINS = (0, 140, 10)
DISTANCE_BREAKS = (0, 45, 90, 125, 175, 200, 250, 300, 350, 400, 450, 500)
PLATE_X, PLATE_Y = 128, 208  # home plate in hit-coordinate units
ANGLE_FACTOR = 0.75
SEED = 42
TRAIN_SHARE, TEST_SHARE_OF_REST = 0.15, 0.5
PLOT_SHARE = 0.25
OUT_OF_ZONE = "Out of Zone"
# --- end of fixed values ------------------------------------------------------

# Default pitch zones. The rule behind the published zone labels is not public,
# so this table is our own: the strike zone drawn at |px| <= 0.9 and
# 1.5 <= pz <= 3.5, cut into a heart and the inside / outside / high / low edges.
# Rows are (stand, x_lo, x_hi, z_lo, z_hi, label); the first match wins.
DEFAULT_ZONES = (
    ("R", -0.6, 0.6, 1.8, 3.2, "Heart"),
    ("L", -0.6, 0.6, 1.8, 3.2, "Heart"),
    ("R", -0.9, -0.6, 1.5, 3.5, "Inside Edge"),
    ("R", 0.6, 0.9, 1.5, 3.5, "Outside Edge"),
    ("L", 0.6, 0.9, 1.5, 3.5, "Inside Edge"),
    ("L", -0.9, -0.6, 1.5, 3.5, "Outside Edge"),
    ("R", -0.9, 0.9, 3.2, 3.5, "Upper Edge"),
    ("L", -0.9, 0.9, 3.2, 3.5, "Upper Edge"),
    ("R", -0.9, 0.9, 1.5, 1.8, "Lower Edge"),
    ("L", -0.9, 0.9, 1.5, 1.8, "Lower Edge"),
)
ZONE_SCHEMA = "stand string, x_lo double, x_hi double, z_lo double, z_hi double, label string"
