"""Toxicity by character n-grams: a linear classifier on features scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineout.llm.common import fitting_ids, held_out, map_arrow, stored
from lineout.llm.words import BLOCK_BYTES, blocks, mixed, text_bytes

ORDERS = (3, 4, 5)
BITS = 18  # n-grams are hashed to 2 ** BITS features
EVIDENCE = 4.0  # standard deviations by which a feature's share of toxic documents must differ from the sample's
FIT_ROWS = 4000  # labelled rows per class, at most
PENALTY = 1e-3
STEPS = 50

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_NO_KEYS = np.zeros(0, np.int64)


@dataclass
class Model:
    """Score of a text: logistic(bias + sum of the weights of its distinct features)."""

    weights: np.ndarray  # 2 ** BITS values
    bias: float

    @property
    def wanted(self) -> np.ndarray:
        return self.weights != 0


def _characters(data: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Characters that begin from ``start`` to ``end``, with those an n-gram needs behind them.

    Returns a number for each (its bytes, A-Z lower-cased), its place, and how many begin before ``end``.
    """
    part = data[start : end + 4 * max(ORDERS)]
    at = np.flatnonzero((part & 0xC0) != 0x80)
    own = int(np.searchsorted(at, end - start))
    at = at[: own + max(ORDERS) - 1]
    letters, lead = np.append(_LOWER[part], np.zeros(3, np.uint64)), part[at]
    code = letters[at]
    for j, least in enumerate((0xC0, 0xE0, 0xF0), 1):
        code |= np.where(lead >= least, letters[at + j] << np.uint64(8 * j), np.uint64(0))
    return code, at + start, own


def _keys(data: np.ndarray, offsets: np.ndarray, start: int, end: int, wanted: np.ndarray | None) -> np.ndarray:
    """(row, feature) of every n-gram that begins from ``start`` to ``end`` and ends in its row, as one number.

    With ``wanted`` (a flag per feature) the others are left out before anything is sorted.
    """
    letters, at, own = _characters(data, start, end)
    row = np.searchsorted(offsets, at, side="right") - 1
    code, found = letters, [_NO_KEYS]
    for n in range(2, max(ORDERS) + 1):
        size = len(letters) - n + 1
        if size <= 0:
            break
        code = mixed(code[:size]) + letters[n - 1 :]
        if n in ORDERS:
            inside = (row[:size] == row[n - 1 :]) & (np.arange(size) < own)
            hashed = (mixed(code[inside] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
            if wanted is None:
                found.append((row[:size][inside] << BITS) | hashed)
            else:
                at = np.flatnonzero(wanted[hashed])
                found.append((row[:size][inside][at] << BITS) | hashed[at])
    return np.unique(np.concatenate(found))


def _row_features(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, row), in order of row and feature. A long text is read in slices."""
    data, offsets = text_bytes(batch.column("text"))
    keys = _NO_KEYS
    for start in range(0, len(data), BLOCK_BYTES):
        found = _keys(data, offsets, start, min(start + BLOCK_BYTES, len(data)), wanted)
        keys = np.union1d(keys, found) if len(keys) else found
    return keys & ((1 << BITS) - 1), keys >> BITS


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class in which a feature occurs: at most 2 ** BITS rows a task."""
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in blocks(batches):
        feature, row = _row_features(batch)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[row] == 1
        for side in (0, 1):
            seen[side] += np.bincount(feature[toxic == side], minlength=1 << BITS)
    used = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0, used]), pa.array(seen[1, used])], ["feature", "clean", "toxic"])


def _ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log-count ratio of each feature, 0 where chance explains its counts (``EVIDENCE``)."""
    ratio = np.log((toxic + 1.0) / (n_toxic + 2.0)) - np.log((clean + 1.0) / (n_clean + 2.0))
    share, both = n_toxic / (n_toxic + n_clean), clean + toxic
    apart = np.abs(toxic - share * both) / np.sqrt(np.maximum(both, 1) * share * (1 - share))
    return np.where(apart >= EVIDENCE, ratio, 0.0)


VECTORS = T.StructType([T.StructField("toxic", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("features", VectorUDT())])
_STORED = "toxic double, weight double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def _vectors(ratio: np.ndarray, share: tuple[float, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sparse vectors, in the layout in which Spark stores them, of the ratios of each document's features.

    Features without a ratio have no place in them.
    """
    wanted = ratio != 0
    place, size = (np.cumsum(wanted) - 1).astype(np.int32), max(1, int(wanted.sum()))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            feature, row = _row_features(batch, wanted)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(float)
            same = np.zeros(batch.num_rows, np.int8), np.full(batch.num_rows, size, np.int32)
            lists = (pa.ListArray.from_arrays(ends, pa.array(v)) for v in (place[feature], ratio[feature]))
            vector = pa.StructArray.from_arrays([*map(pa.array, same), *lists], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(np.where(toxic == 1, share[1], share[0])), vector], ["toxic", "weight", "features"])

    return vectors


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled documents per class, taken by hash of the id from those not held out.

    Each feature's ratio is log of its smoothed document frequency among toxic
    over that among other documents. Logistic regression on the features so
    scaled, both classes weighing the same, gives one weight per feature, its
    gradients (a number per kept feature) summed on the executors; the bias is then moved to the labelled share
    of toxic documents. None if a class has no rows. The driver gets 2 ** BITS
    counts and holds a few vectors of that length, never features of documents.
    """
    usable = labels.filter(~held_out(F.col("doc_id")))
    ids = [fitting_ids(usable, "toxic", value, rows).withColumn("toxic", F.lit(value)) for value in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")  # 2 * rows ids
    sample = stored(sample.select("toxic", "text"))
    sizes = dict(sample.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return None
    counts = map_arrow(sample, _feature_counts, "feature long, clean long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = [counts.column(name).to_numpy() for name in ("clean", "toxic")]
    scale = np.zeros(1 << BITS)
    scale[counts.column("feature").to_numpy()] = _ratios(*seen, sizes[0], sizes[1])
    share = tuple(sum(sizes.values()) / (2.0 * sizes[side]) for side in (0, 1))
    vectors = stored(map_arrow(sample, _vectors(scale, share), _STORED), VECTORS)
    fitted = LogisticRegression(
        labelCol="toxic", weightCol="weight", regParam=PENALTY, standardization=False, maxIter=STEPS, tol=1e-5).fit(vectors)
    labelled = dict(usable.filter("toxic IN (0, 1)").groupBy("toxic").count().collect())
    bias = fitted.intercept + np.log(labelled[1] / labelled[0])
    weights = np.zeros(1 << BITS)
    used = np.flatnonzero(scale)
    weights[used] = fitted.coefficients.toArray()[: len(used)] * scale[used]
    return Model(weights, float(bias))


def _chances(batch: pa.RecordBatch, model: Model | None, wanted: np.ndarray | None) -> np.ndarray:
    margin = np.full(batch.num_rows, model.bias if model else 0.0)
    if model:
        feature, row = _row_features(batch, wanted)
        margin += np.bincount(row, model.weights[feature], minlength=batch.num_rows)
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _scorer(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    wanted = model.wanted if model else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_chances(batch, model, wanted))], ["doc_id", "score"])

    return score


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``."""
    model = fit(docs, labels, rows)
    wanted = model.wanted if model else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array(_chances(batch, model, wanted) < threshold))

    return map_arrow(docs, keep, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score reads the text alone. Null and empty texts get the bias, the score
    of a text without known features; so does every text if the labels hold no
    row of one class (0.5 then). Rows are scored one by one, so repeated rows and
    ids give repeated rows; an empty table gives none. A null id is not held out.
    """
    model = fit(docs, labels, rows)
    scored = map_arrow(docs.select("doc_id", "text"), _scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, labels)
