"""Classifier evaluation: ROC, cutoff, confusion, metrics, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineout.functions import labels as L
from lineout.operators.running import running_totals

METRICS = ("recall", "precision", "specificity", "accuracy", "f1")


def roc_curve(df: DataFrame, score: str = "p", label: str = "hit") -> DataFrame:
    """One point per distinct score, counting rows at or above it as positive.

    Columns cutoff, tp, fp, tpr, fpr; the first point is cutoff infinity with
    nothing positive. Rates are NULL when a class is absent.
    """
    points = (
        df.select(F.col(score).alias("cutoff"), F.col(label).alias("_y")).dropna()
        .groupBy("cutoff")
        .agg(F.sum("_y").cast("bigint").alias("pos"), F.sum(1 - F.col("_y")).cast("bigint").alias("neg"))
    )
    curve = running_totals(points, "cutoff", ["pos", "neg"], descending=True).select(
        "cutoff", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
        F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
    )
    totals = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    zero = F.lit(0).cast("bigint")
    start = totals.select(
        F.lit(float("inf")).alias("cutoff"), zero.alias("tp"), zero.alias("fp"),
        F.try_divide(zero, F.col("p")).alias("tpr"), F.try_divide(zero, F.col("n")).alias("fpr"),
    )
    return start.unionByName(curve)


def best_cutoff(roc: DataFrame) -> DataFrame:
    """The ROC point nearest (fpr 0, tpr 1); ties go to the highest cutoff."""
    distance = F.col("fpr") * F.col("fpr") + (F.col("tpr") - 1) * (F.col("tpr") - 1)
    point = F.struct(
        F.col("tpr").alias("sensitivity"), (1 - F.col("fpr")).alias("specificity"), F.col("cutoff"),
    )
    nearest = F.min_by(point, F.struct(distance, -F.col("cutoff")))
    return roc.filter(distance.isNotNull()).agg(nearest.alias("best")).select("best.*")


def apply_cutoff(
    df: DataFrame, cutoff: DataFrame | float, score: str = "p", name: str = "fit", inclusive: bool = False,
) -> DataFrame:
    """Add a 0/1 prediction; ``cutoff`` is a number or the result of best_cutoff."""
    value = cutoff.select("cutoff").scalar() if isinstance(cutoff, DataFrame) else F.lit(cutoff)
    return df.withColumn(name, L.threshold(F.col(score), value, inclusive))


def confusion(
    df: DataFrame, actual: str = "hit", predicted: str = "fit", by: Sequence[str] = (),
) -> DataFrame:
    """Rows per (actual, predicted); rows missing either are left out."""
    return (
        df.dropna(subset=[actual, predicted])
        .groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """The metric set from four counts; a ratio over nothing is NULL."""
    return [
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        # 2PR / (P + R), which is undefined when nothing is predicted positive.
        F.when(tp + fp > 0, F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    ]


def metrics(
    df: DataFrame, actual: str = "hit", predicted: str = "fit", by: Sequence[str] = (),
) -> DataFrame:
    """Counts and metrics of a 0/1 prediction, overall or per group, in one pass."""
    y, f = F.col(actual) == 1, F.col(predicted) == 1
    counts = (
        df.dropna(subset=[actual, predicted]).groupBy(*by)
        .agg(
            F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"),
            F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn"),
        )
    )
    return counts.select("*", *_metric_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One-against-the-rest metrics for each class, from the confusion counts."""
    cells = confusion(df, actual, predicted)
    total = cells.agg(F.sum("n").alias("n")).scalar()
    hit = F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("bigint")
    as_actual = F.struct(
        F.col("actual").alias("class"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
        zero.alias("fp"), F.when(hit, zero).otherwise(F.col("n")).alias("fn"),
    )
    as_predicted = F.struct(
        F.col("predicted").alias("class"), zero.alias("tp"),
        F.when(hit, zero).otherwise(F.col("n")).alias("fp"), zero.alias("fn"),
    )
    sums = (
        cells.select(F.inline(F.array(as_actual, as_predicted))).groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        .withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))
    )
    return sums.select("*", *_metric_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def baselines(df: DataFrame, actual: str = "hit", share: float = 0.5) -> DataFrame:
    """Metrics of predicting all hits, all outs, or a hit with a fixed chance.

    The chance row uses the expected counts, so it needs no random draw.
    """
    base = df.dropna(subset=[actual]).agg(
        F.count_if(F.col(actual) == 1).cast("double").alias("p"),
        F.count_if(F.col(actual) != 1).cast("double").alias("n"),
    )
    chances = F.array(*[
        F.struct(F.lit(name).alias("model"), F.lit(float(q)).alias("q"))
        for name, q in (("all hits", 1), ("all outs", 0), ("coin flip", share))
    ])
    p, n, q = F.col("p"), F.col("n"), F.col("q")
    counts = base.select("p", "n", F.inline(chances)).select(
        "model", (p * q).alias("tp"), (n * q).alias("fp"),
        (p * (1 - q)).alias("fn"), (n * (1 - q)).alias("tn"),
    )
    return counts.select("model", *_metric_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def comparison_table(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Metrics down, models across, from rows of (model, metric columns)."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    long = results.select("model", F.expr(f"stack({len(METRICS)}, {pairs}) AS (metric, value)"))
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))
