"""Hit-or-out model: prepare, fit, choose a cutoff, score, report, save.

The prepared table and the scored table are each used many times, so both are
written once to the shared folder; every report is one aggregation over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.functions import labels as L
from lineout.operators import clean, evaluate, features, models, reports, sampling, stats
from lineout.sources.write import materialise, save_model, write_report, write_table

NUMERIC, CATEGORICAL = models.FEATURE_SETS["model 5"]
MAJORITY = 0.5
TEAM_NAMES = (
    "fieldingTeam", "expected_outs_total", "expected_outs_converted", "unexpected_outs_converted",
    "expected_hits_total", "expected_outs_perc", "unexpected_outs_perc",
)
AVERAGE_NAMES = ("fieldingTeam", "n()", "expected_ba", "actual_ba")


def prepare(raw: DataFrame, until: str | None = None, key: Sequence[str] = S.RAW_COLUMNS) -> DataFrame:
    """Typed, labelled, complete rows with a record id and a split label.

    ``key`` lists the columns that identify a record in the extracts.
    """
    df = clean.with_outcomes(clean.clean_extract(clean.with_row_key(raw, key)))
    if until is not None:
        df = clean.until(df, until)
    rows = clean.complete_cases(clean.modelling_rows(df), S.CATEGORIES).select(*S.MODEL_COLUMNS)
    return materialise(sampling.three_way_split(materialise(rows)))


def fit(
    prepared: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, **options,
) -> PipelineModel:
    """Fit scaler, indexers and forest on the training rows alone."""
    options.setdefault("mtry", models.MTRY.get((tuple(numeric), tuple(categorical))))
    pipeline = models.forest(numeric, categorical, **options)
    return pipeline.fit(prepared.filter(F.col("split") == "train").select("hit", *numeric, *categorical))


def score(model: PipelineModel, prepared: DataFrame, cutoff: float | DataFrame = MAJORITY) -> DataFrame:
    """Every prepared row with its hit probability ``p`` and prediction ``fit``."""
    scored = materialise(models.score_hits(model, prepared))
    return evaluate.apply_cutoff(scored, cutoff)


def compare_models(
    prepared: DataFrame, sets: Mapping[str, tuple] = models.FEATURE_SETS, share: float = 0.3, **options,
) -> DataFrame:
    """Metrics by model on the test rows, each at its own best cutoff, with baselines."""
    test = prepared.filter(F.col("split") == "test")
    tables = []
    for name, (numeric, categorical) in sets.items():
        scored = materialise(models.score_hits(fit(prepared, numeric, categorical, **options), test).select("hit", "p"))
        fitted = evaluate.apply_cutoff(scored, evaluate.best_cutoff(evaluate.roc_curve(scored)))
        tables.append(evaluate.metrics(fitted).select(F.lit(name).alias("model"), *evaluate.METRICS))
    tables.append(evaluate.baselines(test, share=share))
    names = [*sets, "coin flip", "all hits", "all outs"]
    return evaluate.comparison_table(reduce(DataFrame.unionByName, tables), names)


def report_tables(prepared: DataFrame, scored: DataFrame) -> dict[str, DataFrame]:
    """All report tables over the rows outside training."""
    rest = sampling.out_of_training(scored)
    buckets = reports.compare_buckets(
        reports.rounded(reports.predicted_by_bucket(rest), ["ave_prob"]),
        reports.rounded(reports.empirical_by_bucket(prepared), ["empirical_ave"]),
    )
    return {
        "class_shares": reports.class_shares(prepared, "hit", ["split"]),
        "split_sizes": sampling.split_sizes(prepared),
        "holdout_metrics": evaluate.metrics(rest, by=["split"]),
        "confusion": evaluate.confusion(rest),
        "miss_profile": reports.miss_profile(rest),
        "bucket_comparison": buckets,
        "probability_of_hit": reports.bucket_display(buckets, order="label"),
        "detailed_probability": reports.detail_display(reports.detail_grid(rest)),
        "calibration_fit": stats.linear_fit(buckets, "empirical_ave", "ave_prob"),
        "conversion_by_team": reports.conversion_by_team(rest).toDF(*TEAM_NAMES),
        "average_by_team": reports.average_by_team(rest).toDF(*AVERAGE_NAMES),
        "overall_average": reports.overall_average(rest),
        "accuracy_by_distance": reports.rounded(reports.accuracy_by_distance(rest), ["correct_perc"]),
        "spray_extract": reports.spray_extract(rest),
    }


def run(raw: DataFrame, folder: str, until: str | None = None, key: Sequence[str] = S.RAW_COLUMNS, **options) -> None:
    """Raw extracts to reports, model and parameters under ``folder``."""
    prepared = prepare(raw, until, key)
    model = fit(prepared, **options)
    scored = score(model, prepared)
    for name, table in report_tables(prepared, scored).items():
        write_report(table, f"{folder}/{name}")
    train = prepared.filter(F.col("split") == "train")
    write_table(features.scale_table(train), f"{folder}/scale")
    for category in S.CATEGORIES:
        write_table(features.level_table(train, category), f"{folder}/levels_{category}")
    save_model(model, f"{folder}/model")


def score_new(model: PipelineModel, raw: DataFrame, key: Sequence[str] = S.RAW_COLUMNS) -> DataFrame:
    """Score an extract the model has not seen; works on a stream as well.

    Each row is handled by itself: the stored scaler and category levels apply,
    and a level unknown to the model keeps its text and gets the spare index.
    """
    df = clean.with_outcomes(clean.clean_extract(clean.with_row_key(raw, key)))
    needed = [c for stage in model.stages for c in _inputs(stage) if c in df.columns]
    scored = models.score_hits(model, clean.complete_cases(df, needed))
    return scored.withColumn("fit", L.threshold(F.col("p"), F.lit(MAJORITY)))


def _inputs(stage) -> list[str]:
    if stage.hasParam("inputCols") and stage.isSet("inputCols"):
        return stage.getInputCols()
    if stage.hasParam("inputCol") and stage.isSet("inputCol"):
        return [stage.getInputCol()]
    return []
