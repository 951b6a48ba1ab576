"""Hit-type model: out, single, double, triple, home run, and their run value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.operators import bayes, clean, evaluate, features, models, reports, sampling

NUMERIC, CATEGORICAL = models.TYPE_FEATURES


def _parts(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    return prepared.filter(F.col("split") == "train"), sampling.out_of_training(prepared)


def type_forests(prepared: DataFrame, **options) -> dict[str, DataFrame]:
    """Class metrics of each forest variant on the hold-out rows."""
    train, rest = _parts(prepared)
    with_angle = [*NUMERIC, "hor_angle"]
    out = {}
    for name, numeric, mtry in (("default", NUMERIC, None), ("mtry 3", NUMERIC, 3), ("spray angle", with_angle, None)):
        seen, held = (clean.complete_cases(d, numeric) for d in (train, rest))
        model = models.forest(numeric, CATEGORICAL, "hit_type", mtry=mtry, **options).fit(seen)
        out[name] = evaluate.class_metrics(models.score_classes(model, held), "hit_type", "fit")
    hits, held = models.only_hits(train), models.only_hits(rest)
    for name, mtry in (("hits only", None), ("hits only, mtry 3", 3)):
        model = models.hits_only_forest(mtry=mtry, **options).fit(hits)
        out[name] = evaluate.class_metrics(models.score_classes(model, held), "hit_type", "fit")
    return out


def two_stage(prepared: DataFrame, **options) -> DataFrame:
    """Hold-out rows with hit-type probabilities from a hit model, then a type model.

    Adds the expected run value of each ball under those probabilities.
    """
    train, rest = _parts(prepared)
    hit_model = models.forest(NUMERIC, CATEGORICAL, "hit", **options).fit(train)
    type_model = models.hits_only_forest(**options).fit(models.only_hits(train))
    scored = models.score_two_stage(hit_model, type_model, rest)
    value = sum((F.col(f"prob_{kind}") * weight for kind, weight in S.RUN_VALUES.items()), F.lit(0.0))
    return scored.withColumn("expected_run_value", value)


def other_classifiers(prepared: DataFrame) -> dict[str, DataFrame]:
    """Additive logistic, naive Bayes and kernel machine on the hold-out rows."""
    train, rest = _parts(prepared)
    ranges = {"hit_angle": (-90.0, 90.0), "hit_speed": (0.0, 140.0)}
    logit = models.spline_logit(ranges, CATEGORICAL).fit(train)
    fitted = bayes.fit_naive_bayes(train, "hit_type", NUMERIC, CATEGORICAL)
    parameters = features.scale_parameters(train, NUMERIC)
    seen, held = (features.apply_scale(d, parameters, NUMERIC, "_z") for d in (train, rest))
    machine = models.kernel_svm([f"{c}_z" for c in NUMERIC], CATEGORICAL).fit(seen)
    by_bayes = bayes.predict_naive_bayes(rest, fitted, NUMERIC, CATEGORICAL)
    return {
        "additive logistic": evaluate.metrics(models.predict_only(logit, rest), by=["split"]),
        "naive bayes": reports.contingency(by_bayes, "hit_type", "fit"),
        "kernel machine": reports.contingency(models.predict_only(machine, held), "hit_type", "fit"),
    }
