"""Feature preparation: scaling, category levels, spline and kernel features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout import schema as S


def scale_parameters(df: DataFrame, columns: Sequence[str] = S.SCALED) -> DataFrame:
    """One row with ``center_<c>`` and ``scale_<c>`` (sample sd), in one pass."""
    return df.agg(
        *[F.avg(c).alias(f"center_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"scale_{c}") for c in columns],
    )


def scale_table(df: DataFrame, columns: Sequence[str] = S.SCALED) -> DataFrame:
    """The same parameters as (feature, center, scale) rows, for saving."""
    return scale_parameters(df, columns).select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(f"center_{c}").alias("center"), F.col(f"scale_{c}").alias("scale"),
        ) for c in columns
    ])))


def apply_scale(
    df: DataFrame, parameters: DataFrame, columns: Sequence[str] = S.SCALED, suffix: str = "",
) -> DataFrame:
    """Center and scale each column from itself.

    The one parameter row reaches the rows as a scalar subquery, so nothing is
    joined. With a ``suffix`` the raw columns stay next to the scaled ones.
    """
    row = parameters.select(F.struct(*parameters.columns)).scalar()
    held = df.withColumn("_scale", row)
    scaled = {
        f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_scale.center_{c}"), F.col(f"_scale.scale_{c}"))
        for c in columns
    }
    return held.withColumns(scaled).drop("_scale")


def level_table(df: DataFrame, column: str) -> DataFrame:
    """Distinct levels of a category, missing values left out."""
    return df.select(F.col(column).alias("level")).dropna().distinct()


def index_levels(column: str, output: str | None = None) -> StringIndexer:
    """Estimator numbering the levels of a category in alphabetical order."""
    return StringIndexer(
        inputCol=column, outputCol=output or f"{column}_index",
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )


def index_saved_levels(column: str, levels: Sequence[str], output: str | None = None) -> StringIndexerModel:
    """Number a category by a saved level list; unknown levels share one index.

    Levels are matched by label, never by position.
    """
    return StringIndexerModel.from_labels(
        list(levels), inputCol=column, outputCol=output or f"{column}_index", handleInvalid="keep",
    )


def spline_place_sql(column: str, low: float, high: float, pieces: int = 10) -> dict[str, str]:
    """Knot interval ``k`` (0-based) of a value and its position ``t`` in it, as SQL.

    Values outside ``[low, high]`` are held at the nearer end.
    """
    held = f"least(greatest({column}, {float(low)!r}D), {float(high)!r}D)"
    position = f"CASE WHEN {column} IS NOT NULL THEN ({held} - {float(low)!r}D) / {(high - low) / pieces!r}D END"
    interval = f"least(floor({position}), {pieces - 1})"
    return {"k": interval, "t": f"{position} - {interval}"}


def spline_sql(k: str, t: str, pieces: int = 10) -> list[str]:
    """Cubic B-spline basis on evenly spaced knots, as SQL over interval and position.

    Gives ``pieces + 3`` expressions that sum to 1; four are above zero at a time.
    """
    rest = f"(1D - {t})"

    def hump(u: str) -> str:
        return f"(3D * {u} * {u} * {u} - 6D * {u} * {u} + 4D) / 6D"

    parts = [f"{rest} * {rest} * {rest} / 6D", hump(t), hump(rest), f"{t} * {t} * {t} / 6D"]
    arms = " ".join(f"WHEN {i} THEN {part}" for i, part in enumerate(parts))
    return [
        f"CASE WHEN {k} IS NULL THEN NULL ELSE CASE {j} - {k} {arms} ELSE 0D END END" for j in range(pieces + 3)
    ]


def kernel_sql(columns: Sequence[str], gamma: float, size: int = 32, seed: int = S.SEED) -> list[str]:
    """Random Fourier features, as SQL; inner products approach exp(-gamma |x-y|^2)."""
    draw = np.random.default_rng(seed)
    weights = draw.normal(0.0, np.sqrt(2.0 * gamma), (size, len(columns)))
    phases = draw.uniform(0.0, 2.0 * np.pi, size)
    height = float(np.sqrt(2.0 / size))
    features = []
    for row, phase in zip(weights, phases):
        terms = [f"{c} * {float(w):.17f}D" for c, w in zip(columns, row)]
        features.append(f"cos({' + '.join([*terms, f'{float(phase):.17f}D'])}) * {height:.17f}D")
    return features
