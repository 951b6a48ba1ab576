"""Report tables: buckets, teams, angles, accuracy, plot extracts.

Each is an aggregation with map-side partials, so a team or bucket holding a
third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.functions import bins as B
from lineout.functions import labels as L
from lineout.operators import clean, sampling
from lineout.operators.joins import null_safe_join

ANGLE_EDGES = B.regular_edges(*S.ANGLE_BINS)
SPEED_EDGES = B.regular_edges(*S.SPEED_BINS)
BUCKET = ("angle_bin", "speed_bin")


def rows() -> Column:
    return F.count(F.lit(1))


# --- frequencies and means ----------------------------------------------------

def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, missing values left out."""
    return df.dropna(subset=[column]).groupBy(column).agg(rows().alias("n"))


def class_shares(df: DataFrame, column: str, within: Sequence[str] = ()) -> DataFrame:
    """Share of each value in the total, or in its split."""
    counts = df.dropna(subset=[column]).groupBy(*within, column).agg(rows().alias("n"))
    totals = counts.groupBy(*within).agg(F.sum("n").alias("total"))
    if within:
        counts = null_safe_join(counts, totals, list(within), "left")
    else:
        counts = counts.withColumn("total", totals.scalar())
    return counts.withColumn("share", F.col("n") / F.col("total")).drop("total")


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Rows per pair of values, pairs with a missing value left out."""
    return df.dropna(subset=[row, column]).groupBy(row, column).agg(rows().alias("n"))


def group_mean(df: DataFrame, value: str, by: Sequence[str], name: str = "mean", digits: int | None = None) -> DataFrame:
    mean = F.avg(value)
    return df.groupBy(*by).agg((mean if digits is None else F.bround(mean, digits)).alias(name))


def means_and_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``<c>_mean`` without missing values and ``<c>_n`` for each column."""
    return df.groupBy(*by).agg(*[
        item for c in columns for item in (F.avg(c).alias(f"{c}_mean"), rows().alias(f"{c}_n"))
    ])


def expected_run_value(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, total and mean run value per group."""
    return df.groupBy(*by).agg(
        rows().alias("n"), F.sum("run_value").alias("total"), F.avg("run_value").alias("mean"),
    )


# --- hit probability by bucket -----------------------------------------------

def with_buckets(df: DataFrame, rounded: bool = False) -> DataFrame:
    """Add angle and speed bins; ``rounded`` bins whole degrees and mph."""
    angle, speed = F.col("hit_angle"), F.col("hit_speed")
    if rounded:
        angle, speed = F.bround(angle), F.bround(speed)
    return df.withColumns({
        "angle_bin": B.regular_bin(angle, *S.ANGLE_BINS), "speed_bin": B.regular_bin(speed, *S.SPEED_BINS),
    })


def predicted_by_bucket(scored: DataFrame, score: str = "p") -> DataFrame:
    """Mean predicted probability per bucket of whole degrees and mph."""
    return with_buckets(scored, rounded=True).groupBy(*BUCKET).agg(F.avg(score).alias("ave_prob"))


def empirical_by_bucket(df: DataFrame) -> DataFrame:
    """Rows and hit rate per bucket."""
    return with_buckets(df).groupBy(*BUCKET).agg(rows().alias("n"), F.avg("hit").alias("empirical_ave"))


def compare_buckets(predicted: DataFrame, empirical: DataFrame) -> DataFrame:
    """Predicted next to observed rate; the out-of-range buckets match too."""
    return null_safe_join(predicted, empirical, list(BUCKET))


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in columns})


def bucket_display(table: DataFrame, order: str = "numeric") -> DataFrame:
    """Bucket table as published: range texts and percentages.

    ``order="label"`` sorts by the text of the ranges ("100 to 110" before
    "20 to 30"), ``"numeric"`` by the ranges themselves.
    """
    if order not in ("numeric", "label"):
        raise ValueError("order must be 'numeric' or 'label'")
    text = table.withColumns({
        "angle_text": B.range_text(B.bin_label(F.col("angle_bin"), ANGLE_EDGES)),
        "speed_text": B.range_text(B.bin_label(F.col("speed_bin"), SPEED_EDGES)),
        "chance": L.percent_text(F.bround("ave_prob", 3)),
    })
    keys = BUCKET if order == "numeric" else ("angle_text", "speed_text")
    return text.orderBy(*[F.asc_nulls_last(k) for k in keys]).select(
        F.col("angle_text").alias("Launch Angle Range (degrees)"),
        F.col("speed_text").alias("Exit Velocity Range (mph)"),
        F.col("chance").alias("Predicted Probability of a Hit"),
    )


def detail_grid(scored: DataFrame, score: str = "p") -> DataFrame:
    """Rows and mean probability per whole degree and mph."""
    return scored.groupBy(F.bround("hit_angle").alias("hit_angle"), F.bround("hit_speed").alias("hit_speed")).agg(
        rows().alias("n"), F.avg(score).alias("predicted_probability"),
    )


def detail_display(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc_nulls_last("hit_angle"), F.desc_nulls_last("hit_speed")).select(
        F.col("hit_angle").alias("Launch Angle (degrees)"), F.col("hit_speed").alias("Exit Velocity (mph)"),
        L.percent_text(F.col("predicted_probability")).alias("Predicted Probability of a Hit"),
    )


# --- team defence and accuracy -----------------------------------------------

def with_outcome_flags(df: DataFrame, fit: str = "fit", hit: str = "hit") -> DataFrame:
    return df.withColumns(L.outcome_flags(F.col(fit), F.col(hit)))


def with_correctness(df: DataFrame, fit: str = "fit", hit: str = "hit") -> DataFrame:
    return df.withColumns(L.correctness_labels(F.col(fit), F.col(hit)))


def conversion_by_team(df: DataFrame, team: str = "fielding_team") -> DataFrame:
    """Expected and unexpected outs each team converted."""
    totals = with_outcome_flags(df.dropna(subset=["fit"])).groupBy(team).agg(
        F.sum("expected_outs").alias("expected_outs_total"),
        F.sum("expected_outs_made").alias("expected_outs_converted"),
        F.sum("unexpected_outs_made").alias("unexpected_outs_converted"),
        F.sum("fit").alias("expected_hits_total"),
    )
    return totals.withColumns({
        "expected_outs_perc": F.try_divide("expected_outs_converted", "expected_outs_total"),
        "unexpected_outs_perc": F.try_divide("unexpected_outs_converted", "expected_hits_total"),
    })


def without_home_runs(df: DataFrame) -> DataFrame:
    """Rows of a known event other than a home run."""
    return df.filter(F.col("events") != "Home Run")


def average_by_team(df: DataFrame, team: str = "fielding_team") -> DataFrame:
    """Expected and actual batting average against, home runs left out."""
    return without_home_runs(df.dropna(subset=["fit"])).groupBy(team).agg(
        rows().alias("n"), (F.sum("fit") / rows()).alias("expected_ba"), (F.sum("hit") / rows()).alias("actual_ba"),
    )


def overall_average(df: DataFrame) -> DataFrame:
    return without_home_runs(df).agg(rows().alias("n"), F.try_divide(F.sum("hit"), rows()).alias("actual_ba"))


def accuracy_by_distance(df: DataFrame, breaks: Sequence[float] = S.DISTANCE_BREAKS) -> DataFrame:
    """Rows and share of right predictions per distance band."""
    banded = with_correctness(df).withColumn("distance_bin", B.break_bin(F.col("hit_distance_sc"), breaks))
    table = banded.groupBy("distance_bin").agg(rows().alias("n"), F.avg("miss_num").alias("correct_perc"))
    return table.withColumn("distance_label", B.bin_label(F.col("distance_bin"), breaks))


def miss_profile(df: DataFrame) -> DataFrame:
    """Mean measures of each (actual, predicted) pair: where the model errs."""
    return means_and_counts(df, ["hit_distance_sc", "hit_angle", "hit_speed"], ["hit", "fit"])


# --- extracts behind the plots -------------------------------------------------

def scatter_extract(
    df: DataFrame, x: str, y: str, facets: Sequence[str], ranges: Mapping | None = None,
    share: float = S.PLOT_SHARE, within_facet: str | None = None, key: str = "row_key",
) -> DataFrame:
    """A repeatable sample of points, overall or per level of ``within_facet``."""
    kept = clean.within(df, ranges or {}).select(key, x, y, *facets)
    if within_facet:
        return sampling.stratified_sample(kept, within_facet, share, key)
    return sampling.exact_sample(kept, share, key)


def spray_extract(df: DataFrame) -> DataFrame:
    """Ball locations seen from home plate, by outcome and correctness."""
    view = with_correctness(df).withColumn("y", L.field_view_y(F.col("hc_y")))
    view = clean.within(view.dropna(subset=["miss"]), {"hc_x": (0, 250), "y": (-250, 0)})
    return view.select("row_key", F.col("hc_x").alias("x"), "y", "hit_label", "miss")
