"""Launch angle by pitch location, velocity and count."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lineout import schema as S
from lineout.operators import clean, joins, reports, stats
from lineout.sources.read import balls_in_play

ANGLES = {"hit_angle": (-80, 80), "hit_speed": (90, None)}
WIDE, TALL, MIDDLE = {"px": (-1.5, 1.5)}, {"pz": (1, 5)}, {"pz": (1, 4)}


def prepare(pitches: DataFrame, heights: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Measured balls in play with batter height, zone and pitch labels, no bunts."""
    zones = joins.default_zones(pitches.sparkSession) if zones is None else zones
    df = joins.lookup_join(balls_in_play(pitches), heights, "batter")
    df = clean.with_pitch_labels(clean.with_outcomes(joins.zone_code(df, zones)))
    return clean.exclude(clean.complete_cases(df, S.REQUIRED_MEASURES), "events", S.BUNT_EVENTS)


def mean_tables(prepared: DataFrame) -> dict[str, DataFrame]:
    """Mean angle by side, and by side with velocity, location or count."""
    def mean(ranges, *by):
        rows = clean.within(prepared, {**ranges, **ANGLES})
        return reports.group_mean(rows, "hit_angle", ["stand_label", *by], "average_launch_angle", digits=1)

    return {
        "by_side": mean(MIDDLE),
        "by_velocity": mean(TALL, "velocity_range"),
        "by_location": mean(MIDDLE, "location"),
        "by_count": mean(WIDE, "count"),
    }


def variance_tables(prepared: DataFrame) -> dict[str, DataFrame]:
    """Analysis of variance and pairwise differences, over all rows.

    Unlike the means these are not restricted to the plotted ranges.
    """
    out = {}
    for factor in ("velocity_range", "location"):
        out[f"anova_{factor}"] = stats.anova_two_way(prepared, "hit_angle", "stand_label", factor)
        out[f"tukey_{factor}"] = stats.tukey_pairs(prepared, "hit_angle", "stand_label", factor)
    return out


def plot_tables(prepared: DataFrame) -> dict[str, DataFrame]:
    """Sampled points, smooth trends and box summaries behind the plots."""
    side = ["stand_label"]
    in_zone = prepared.filter(prepared["location"] != S.OUT_OF_ZONE)
    by_pitch = [*side, "pitch_category"]
    return {
        "points_px": reports.scatter_extract(
            prepared, "px", "hit_angle", side, {**WIDE, **ANGLES}, within_facet="stand_label"),
        "points_pz": reports.scatter_extract(
            prepared, "pz", "hit_angle", side, {**TALL, **ANGLES}, within_facet="stand_label"),
        "points_px_by_pitch": reports.scatter_extract(prepared, "px", "hit_angle", by_pitch, {**WIDE, **ANGLES}),
        "points_spin": reports.scatter_extract(
            prepared, "release_spin_rate", "hit_angle", side, {**WIDE, **MIDDLE, **ANGLES}),
        "trend_px": stats.smooth_trend(clean.within(prepared, {**WIDE, **ANGLES}), "hit_angle", "px", 0.05, by=side),
        "trend_pz": stats.smooth_trend(clean.within(prepared, {**TALL, **ANGLES}), "hit_angle", "pz", 0.05, by=side),
        "boxes": stats.box_summary(in_zone, "hit_angle", [*side, "location"]),
    }
