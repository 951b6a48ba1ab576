"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineout.llm.common import fitting_ids, map_arrow, stored
from lineout.llm.words import blocks, mixed, words

BUCKETS = 1 << 16  # hashed unigrams and bigrams
TARGET_ROWS = 50_000  # labelled target documents that the target model reads, at most
SMOOTHING = 1.0
RANGES = 1 << 12


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and each pair of neighbours, and the row it lies in."""
    found = words(column)
    one, row = found.hashes, found.row
    pair = mixed(one[:-1] + np.uint64(3) * one[1:]) if len(one) > 1 else one[:0]
    together = row[:-1] == row[1:] if len(one) > 1 else np.zeros(0, bool)
    hashed = np.concatenate([one, pair[together]]) % np.uint64(BUCKETS)
    return hashed.astype(np.int64), np.concatenate([row, row[:-1][together]] if len(one) > 1 else [row])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's count of every bucket: at most ``BUCKETS`` rows."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in blocks(batches):
        total += np.bincount(_buckets(batch.column("text"))[0], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def bucket_chances(docs: DataFrame) -> np.ndarray:
    """Smoothed chance of each bucket over all texts of ``docs``; ``BUCKETS`` numbers reach the driver."""
    counted = map_arrow(docs.select("text"), _counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.full(BUCKETS, SMOOTHING)
    found = counted.toArrow()
    total[found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return total / total.sum()


def _weigher(log_ratio: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            bucket, row = _buckets(batch.column("text"))
            weight = np.bincount(row, log_ratio[bucket], minlength=batch.num_rows)
            features = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(features.astype(np.int64)), pa.array(weight.astype(np.float64))], ["doc_id", "n_features", "log_weight"]
            )

    return weigh


def importance_weights(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """(doc_id, n_features, log_weight): log of target over raw likelihood of the whole text.

    The raw model counts all documents, the target model at most ``rows`` of those
    labelled quality 1, by hash of the id. Texts without words weigh 0, as do all
    texts when no document is labelled 1.
    """
    ids = fitting_ids(labels, "quality", 1, rows)
    raw = bucket_chances(docs)
    target = bucket_chances(docs.join(F.broadcast(ids), "doc_id", "left_semi"))  # at most ``rows`` ids
    ratio = np.log(target / raw) if ids.head(1) else np.zeros(BUCKETS)
    return map_arrow(docs.select("doc_id", "text"), _weigher(ratio), "doc_id long, n_features long, log_weight double")


def gumbel_top_k(weighed: DataFrame, share: float, seed: str = "gumbel") -> DataFrame:
    """Mark ``kept`` on the top ``round(share * rows)`` rows by log_weight + Gumbel noise.

    This samples that many rows without replacement in proportion to their
    weights. The noise comes from md5 of seed and id, so reruns agree, and ties
    stand by id. Only counts per range of keys are gathered to find the cut;
    ranges are fixed by approximate quantiles and only one of them is ranked.
    """
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    uniform = (digits.cast("double") + 0.5) / F.lit(float(16**13))
    keyed = stored(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    edges = keyed.agg(F.percentile_approx("key", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("e")).first().e or []
    edges = sorted(set(edges))
    ranged = keyed.withColumn("range", F.lit(0))
    if edges:
        schema = T.StructType([*keyed.schema.fields, T.StructField("range", T.IntegerType())])
        ranged = map_arrow(keyed, _ranger(np.array(edges)), schema)
    counts = ranged.groupBy("range").count().orderBy(F.desc("range")).collect()  # at most RANGES rows
    left = int(round(share * sum(r["count"] for r in counts)))
    cut, part = -1, 0
    for r in counts:
        if r["count"] > left:
            cut, part = r["range"], left
            break
        left -= r["count"]
    ties = W.partitionBy("range").orderBy(F.desc("key"), "doc_id")
    inside = ranged.filter(F.col("range") == cut).withColumn("kept", F.row_number().over(ties) <= part)
    outside = ranged.filter(F.col("range") != cut).withColumn("kept", F.col("range") > cut)
    return outside.unionByName(inside).drop("range")


def _ranger(edges: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(edges, batch.column("key").to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "range"])

    return place


def target_share(weighed: DataFrame, labels: DataFrame) -> float:
    """Share of documents to keep: the labelled share of quality 1; all if nothing is labelled."""
    seen = weighed.select("doc_id").distinct().join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    counts = dict(seen.groupBy("quality").count().filter("quality IN (0, 1)").collect())
    return counts.get(1, 0) / sum(counts.values()) if counts else 1.0


def select_quality(docs: DataFrame, labels: DataFrame, share: float | None = None, rows: int = TARGET_ROWS) -> DataFrame:
    """One row per document: doc_id, n_features, log_weight, key, kept.

    ``share`` of all rows is kept, by default the share of quality 1 among the
    labelled documents. A null text counts as empty; null ids share one noise
    value and rows that repeat an id have equal noise. An empty table gives no rows.
    """
    weighed = stored(importance_weights(docs, labels, rows))
    return gumbel_top_k(weighed, target_share(weighed, labels) if share is None else share)


def op2_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return select_quality(docs, labels)
