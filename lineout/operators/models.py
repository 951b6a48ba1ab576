"""Classifiers as Spark ML pipelines.

Scaler, category indexers and model live in one ``Pipeline``, so a saved model
scores a new table with ``transform`` alone and predictions stay on their rows.
Forests here average leaf distributions and have no out-of-bag error; model
choices use hold-out rows instead.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.operators.features import index_levels, kernel_sql, spline_place_sql, spline_sql
from lineout.sources.write import materialise

# The five feature sets compared for the hit model, by name.
FEATURE_SETS = {
    "model 1": (S.SCALED, S.CATEGORIES),
    "model 2": (S.SCALED, ("stand",)),
    "model 3": (S.REQUIRED_MEASURES, ()),
    "model 4": (("hit_distance_sc",), ()),
    "model 5": (("hit_speed", "hit_angle"), S.CATEGORIES),
}
# Features per split where the published setting is not the default.
MTRY = {FEATURE_SETS["model 5"]: 2}
TYPE_FEATURES = (("hit_speed", "hit_angle"), S.CATEGORIES)
LABEL = "_label"  # class numbers assigned by the pipeline itself
BINS = 64  # split candidates; give more (max_bins) for a category with as many levels


def _scaled(numeric: Sequence[str]) -> list:
    if not numeric:
        return []
    return [
        VectorAssembler(inputCols=list(numeric), outputCol="_measures"),
        StandardScaler(inputCol="_measures", outputCol="_scaled", withMean=True, withStd=True),
    ]


def _tree_features(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Scaled measures next to category indexes; trees split categories directly."""
    indexers = [index_levels(c) for c in categorical]
    parts = [*(["_scaled"] if numeric else []), *[f"{c}_index" for c in categorical]]
    return [*_scaled(numeric), *indexers, VectorAssembler(inputCols=parts, outputCol="features")]


def one_hot_features(vectors: Sequence[str], categorical: Sequence[str]) -> list:
    indexers = [index_levels(c) for c in categorical]
    encoder = [OneHotEncoder(
        inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_flags" for c in categorical],
    )] if categorical else []
    parts = [*vectors, *[f"{c}_flags" for c in categorical]]
    return [*indexers, *encoder, VectorAssembler(inputCols=parts, outputCol="features")]


def forest(
    numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "hit", trees: int = 501,
    depth: int = 10, mtry: int | None = None, max_bins: int = BINS, seed: int = S.SEED,
) -> Pipeline:
    """Random forest over measures and categories; ``mtry`` features per split.

    The label column holds class numbers 0..k-1.
    """
    model = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, maxBins=max_bins, seed=seed,
        featureSubsetStrategy="auto" if mtry is None else str(mtry),
    )
    return Pipeline(stages=[*_tree_features(numeric, categorical), model])


def index_classes(label: str = "hit_type", output: str = LABEL) -> StringIndexer:
    """Number the classes present in a subset from 0, unused ones left out."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc", handleInvalid="skip")


def hits_only_forest(label: str = "hit_type", **options) -> Pipeline:
    """Forest over the classes present in a subset, numbered afresh."""
    numeric, categorical = options.pop("numeric", TYPE_FEATURES[0]), options.pop("categorical", TYPE_FEATURES[1])
    inner = forest(numeric, categorical, label=LABEL, **options)
    return Pipeline(stages=[index_classes(label), *inner.getStages()])


def only_hits(df: DataFrame, label: str = "hit_type") -> DataFrame:
    return df.filter(F.col(label) != 0)


def _is_label_index(stage) -> bool:
    return isinstance(stage, StringIndexerModel) and stage.getOutputCol() == LABEL


def class_labels(model: PipelineModel) -> list[int] | None:
    """Class values in class-number order, if the model numbered them itself."""
    found = [stage.labels for stage in model.stages if _is_label_index(stage)]
    return [int(v) for v in found[0]] if found else None


def scorer(model: PipelineModel) -> PipelineModel:
    """The model without its label stage, so rows of any outcome can be scored."""
    return PipelineModel([stage for stage in model.stages if not _is_label_index(stage)])


def _class_value(model: PipelineModel) -> Column:
    code, labels = F.col("prediction").cast("int"), class_labels(model)
    return code if labels is None else F.try_element_at(F.array(*[F.lit(v) for v in labels]), code + 1)


def _without(df: DataFrame, *names: str) -> list[str]:
    """Columns to carry along when columns of these names are added."""
    return [c for c in df.columns if c not in names]


def score_hits(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """Add the probability of a hit to each row, replacing a column of that name."""
    chance = vector_to_array("probability")[1].alias(name)
    return scorer(model).transform(df).select(*_without(df, name), chance)


def score_classes(model: PipelineModel, df: DataFrame, name: str = "fit") -> DataFrame:
    """Add the predicted class and the list of class probabilities."""
    listed = f"{name}_probabilities"
    return scorer(model).transform(df).select(
        *_without(df, name, listed), _class_value(model).alias(name), vector_to_array("probability").alias(listed),
    )


def predict_only(model: PipelineModel, df: DataFrame, name: str = "fit") -> DataFrame:
    """Add the predicted class of a model that gives no probabilities."""
    return scorer(model).transform(df).select(*_without(df, name), _class_value(model).alias(name))


def importance(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str], spark) -> DataFrame:
    """Impurity importance per feature, one row each."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip([*numeric, *categorical], values)), "feature string, importance double")


def donor_rows(
    df: DataFrame, columns: Sequence[str], key: str = "row_key", seed: int = S.SEED, digits: int = 2,
) -> DataFrame:
    """Give each row, as struct ``_donor``, the values of another random row.

    Rows fall into 16 ** ``digits`` blocks by the first digits of a hash, the same
    at every table size, and each takes the values of its successor in hash order,
    the last of a block taking those of the first: a permutation, done without
    ordering the whole table in one task.
    """
    order = F.md5(F.concat(F.lit(f"donor{seed}|"), F.col(key)))
    block = W.partitionBy("_block")
    ordered = block.orderBy("_order")
    values = F.struct(*columns)
    first = F.first(values).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (
        df.withColumns({"_block": F.substring(order, 1, digits), "_order": order})
        .withColumn("_donor", F.coalesce(F.lead(values).over(ordered), first))
        .drop("_block", "_order")
    )


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], label: str = "hit",
    key: str = "row_key", seed: int = S.SEED,
) -> DataFrame:
    """Accuracy lost when one feature is shuffled between rows.

    All features share one shuffle: each row is scored once per feature with
    that feature alone taken from its donor, and once unchanged.
    """
    donors = donor_rows(df.select(key, label, *features), features, key, seed)
    variants = donors.withColumn("_swap", F.explode(F.array(F.lit(""), *[F.lit(c) for c in features])))
    swapped = variants.withColumns({
        c: F.when(F.col("_swap") == c, F.col(f"_donor.{c}")).otherwise(F.col(c)) for c in features
    }).select(key, label, "_swap", *features)
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    accuracy = model.transform(swapped).groupBy("_swap").agg(right.alias("accuracy"))
    base = accuracy.filter(F.col("_swap") == "").select("accuracy").scalar()
    return accuracy.filter(F.col("_swap") != "").select(
        F.col("_swap").alias("feature"), "accuracy", (base - F.col("accuracy")).alias("loss"),
    )


def error_by_trees(
    train: DataFrame, test: DataFrame, grid: Sequence[int], numeric: Sequence[str],
    categorical: Sequence[str] = (), label: str = "hit", **options,
) -> DataFrame:
    """Hold-out error for each forest size."""
    wrong = F.avg((F.col("prediction") != F.col(label)).cast("double"))
    rows = []
    for trees in grid:
        model = forest(numeric, categorical, label, trees=trees, **options).fit(train)
        rows.append((trees, model.transform(test).agg(wrong).first()[0]))
    return train.sparkSession.createDataFrame(rows, "trees int, error double")


def tune_mtry(
    train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
    label: str = "hit", step: float = 0.5, improve: float = 0.05, **options,
) -> DataFrame:
    """Search the number of features per split outwards from its square root.

    Each direction multiplies or divides by the step until the hold-out error
    stops falling by at least ``improve`` of itself.
    """
    width = len(numeric) + len(categorical)
    factor = max(step, 1 / step)
    wrong = F.avg((F.col("prediction") != F.col(label)).cast("double"))

    def error(mtry: int) -> float:
        model = forest(numeric, categorical, label, mtry=mtry, **options).fit(train)
        return model.transform(test).agg(wrong).first()[0]

    start = max(1, int(math.sqrt(width)))
    errors = {start: error(start)}
    for move in (lambda m: max(1, math.ceil(m / factor)), lambda m: min(width, int(m * factor))):
        here = start
        while (there := move(here)) != here:
            errors[there] = errors[there] if there in errors else error(there)
            if errors[here] <= 0 or 1 - errors[there] / errors[here] < improve:
                break
            here = there
    return train.sparkSession.createDataFrame(sorted(errors.items()), "mtry int, error double")


def with_folds(df: DataFrame, folds: int, key: str = "row_key") -> DataFrame:
    """Fold number from the key's hash: the same on every run and cluster."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))


def cross_validate(
    df: DataFrame, pipeline: Pipeline, grid: list, label: str, folds: int = 5, parallelism: int = 4,
    key: str = "row_key",
):
    """Fit every grid point on every fold; models fit side by side."""
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=folds,
        parallelism=parallelism, foldCol="_fold",
    )
    return search.fit(with_folds(df, folds, key))


def feature_count_error(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "hit",
    folds: int = 5, key: str = "row_key", side_by_side: int = 4, **options,
) -> DataFrame:
    """Cross-validated error as the least important features are dropped by halves: (features, error).

    Every fold ranks the features on its own training rows, so held-out rows never
    choose them. Forests of different folds are fitted side by side.
    """
    rows = materialise(with_folds(df.select(key, label, *numeric, *categorical), folds, key))
    width = len(numeric) + len(categorical)
    sizes = [width // 2**i for i in range(width.bit_length()) if width // 2**i]

    def fold_errors(fold: int) -> list[tuple[int, int, int]]:
        train, held = rows.filter(F.col("_fold") != fold), rows.filter(F.col("_fold") == fold)
        model, kept, found = forest(numeric, categorical, label, **options).fit(train), [*numeric, *categorical], []
        ranks = dict(zip(kept, model.stages[-1].featureImportances.toArray()))
        for size in sizes:
            if size < len(kept):
                kept = sorted(kept, key=lambda c: (-ranks[c], c))[:size]
                model = forest([c for c in numeric if c in kept], [c for c in categorical if c in kept], label, **options).fit(train)
            wrong = F.sum((F.col("prediction") != F.col(label)).cast("long"))
            found.append((size, *model.transform(held).agg(F.coalesce(wrong, F.lit(0)), F.count(F.lit(1))).first()))
        return found

    with ThreadPool(side_by_side) as pool:
        every = [row for found in pool.map(fold_errors, range(folds), chunksize=1) for row in found]
    total = {size: [sum(r[i] for r in every if r[0] == size) for i in (1, 2)] for size in sizes}
    return df.sparkSession.createDataFrame([(size, wrong / n) for size, (wrong, n) in total.items() if n], "features int, error double")


def score_two_stage(hit_model: PipelineModel, type_model: PipelineModel, df: DataFrame) -> DataFrame:
    """Combine hit-or-out with type-given-hit into class probabilities.

    Adds ``prob_0`` .. ``prob_4`` and the most probable class as ``fit``.
    """
    labels = class_labels(type_model)
    first = score_hits(hit_model, df, "_hit")
    chances = [f"prob_{kind}" for kind in (0, *S.RUN_VALUES)]
    kept = _without(df, "fit", *chances)
    both = scorer(type_model).transform(first).select(*kept, "_hit", vector_to_array("probability").alias("_types"))
    both = both.withColumns({"prob_0": 1 - F.col("_hit")} | {
        f"prob_{kind}": F.col("_hit") * (F.col("_types")[labels.index(kind)] if kind in labels else F.lit(0.0))
        for kind in S.RUN_VALUES
    })
    best = F.array_max(F.array(*[
        F.struct(F.col(c).alias("chance"), F.lit(kind).alias("class")) for kind, c in enumerate(chances)
    ]))
    return both.withColumn("fit", best["class"]).drop("_hit", "_types")


def _computed(expressions: Sequence[str], names: Sequence[str]) -> SQLTransformer:
    """Pipeline stage adding computed columns; it is saved with the model."""
    listed = ", ".join(f"{text} AS {name}" for text, name in zip(expressions, names))
    return SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__")


def spline_logit(
    ranges: Mapping[str, tuple[float, float]], categorical: Sequence[str] = (), label: str = "hit",
    pieces: int = 10, ridge: float = 0.001, iterations: int = 50,
) -> Pipeline:
    """Additive logistic model: a cubic spline per measure plus categories.

    The label is out (0) against hit (1). A ridge penalty set by the caller, or
    by ``cross_validate``, stands in for a smoothness penalty estimated from the
    data; the ranges fix the knots.
    """
    place, curves, names = {}, [], []
    for i, (column, (low, high)) in enumerate(ranges.items()):
        place |= {f"_{part}{i}": text for part, text in spline_place_sql(column, low, high, pieces).items()}
        curve = spline_sql(f"_k{i}", f"_t{i}", pieces)
        curves += curve
        names += [f"_s{i}_{j}" for j in range(len(curve))]
    return Pipeline(stages=[
        _computed(list(place.values()), list(place)), _computed(curves, names),
        VectorAssembler(inputCols=names, outputCol="_curves"),
        *one_hot_features(["_curves"], categorical),
        LogisticRegression(labelCol=label, regParam=ridge, maxIter=iterations, standardization=False),
    ])


def kernel_svm(
    scaled: Sequence[str], categorical: Sequence[str] = (), label: str = "hit_type", gamma: float | None = None,
    cost: float = 1.0, size: int = 32, iterations: int = 20, seed: int = S.SEED, numbered: bool = False,
) -> Pipeline:
    """Multiclass support vector machine, one class against the rest.

    ``scaled`` columns are already centred and scaled. Their radial kernel is
    approached by random Fourier features; categories enter as linear flags.
    ``gamma`` defaults to one over the number of features. With ``numbered`` the
    label already holds class numbers and is used as it is.
    """
    gamma = 1.0 / (len(scaled) + len(categorical)) if gamma is None else gamma
    names = [f"_k{i}" for i in range(size)]
    machine = LinearSVC(maxIter=iterations, regParam=1.0 / (1000.0 * cost))
    return Pipeline(stages=[
        _computed(kernel_sql(scaled, gamma, size, seed), names),
        VectorAssembler(inputCols=names, outputCol="_kernel"),
        *one_hot_features(["_kernel"], categorical),
        *([] if numbered else [index_classes(label)]), OneVsRest(classifier=machine, labelCol=label if numbered else LABEL),
    ])


def tune_svm(
    df: DataFrame, scaled: Sequence[str], categorical: Sequence[str] = (), label: str = "hit_type",
    gammas: Sequence[float] = (0.5, 1.0, 2.0), costs: Sequence[float] = (4.0, 8.0, 16.0),
    folds: int = 10, parallelism: int = 4, **options,
) -> DataFrame:
    """Cross-validated error for each kernel width and cost.

    Classes are numbered over all rows before the folds: where a fold's training
    part lacks a class, its held-out rows count as wrong instead of going missing.
    """
    df = index_classes(label, "_class").fit(df).transform(df.dropna(subset=[label])).drop(label)
    rows = []
    for gamma in gammas:
        for cost in costs:
            pipeline = kernel_svm(scaled, categorical, "_class", gamma, cost, numbered=True, **options)
            result = cross_validate(df, pipeline, ParamGridBuilder().build(), "_class", folds, parallelism)
            rows.append((float(gamma), float(cost), 1.0 - float(result.avgMetrics[0])))
    return df.sparkSession.createDataFrame(rows, "gamma double, cost double, error double")
