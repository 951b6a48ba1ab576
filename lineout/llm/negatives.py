"""Hard negatives by a secondary sort of pair scores.

A pair is one key (anchor, descending score, id). Spark sorts the keys within its
partitions, and an iterator reads each anchor's pairs once: a positive opens a window of
scores, the negatives after it that fall in the window are given out. Before the
shuffle, every block of rows leaves out what its own better pairs already rule out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineout.llm.common import map_arrow, stored

ROWS, ANCHORS, LEAST_BLOCKS = 8192, 4096, 8  # of a block; a cell is one block of rows against one of anchors
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score in percent of the positive's
SCALE = 256
TOP = (1 << 63) - 1
KEY = ">QQBQ"  # anchor, descending score, 1 for a negative, id: bytes sort as the numbers do
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame) -> DataFrame:
    """One row per id: (id, label, vector). Of rows that share an id the least label, then vector, stands for all."""
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.dropna(subset=["id", "label", "vector"]).filter(~broken)
    return whole.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.*")


def _matrix(vectors: pa.ListArray, scale: int) -> np.ndarray:
    """Whole numbers floor(scale * x), shorter vectors filled up with zeros."""
    lengths = np.asarray(vectors.value_lengths())
    out = np.zeros((len(vectors), int(lengths.max(initial=0))))
    limit = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        values = np.floor(np.clip(scale * np.asarray(vectors.flatten(), np.float64), -limit, limit))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; beyond 64 bits the nearest long stands for the score."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -TOP, TOP).astype(np.int64)


class _Cell:
    """One block of anchors, and for each of its windows the best few rows met so far."""

    def __init__(self, ids, labels, matrix, windows: list[tuple[np.ndarray, np.ndarray]], same: bool, keep: int):
        self.ids, self.labels, self.matrix, self.windows, self.same, self.keep = ids, labels, matrix, windows, same, keep
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(windows) * len(ids), -TOP)  # the last kept score of a full slot

    def add(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        scores = inner_products(self.matrix, matrix)
        fits = (self.labels[:, None] == labels[None, :]) == self.same
        fits &= self.ids[:, None] != ids[None, :]
        slots, found, rows = [self.slot], [self.score], [self.id]
        for i, (low, high) in enumerate(self.windows):
            first = i * len(self.ids)
            floor = np.maximum(low, self.least[first : first + len(self.ids)])
            anchor, row = np.nonzero(fits & (scores >= floor[:, None]) & (scores <= high[:, None]))
            slots.append(first + anchor)
            found.append(scores[anchor, row])
            rows.append(ids[row])
        slot, score, row = (np.concatenate(x) for x in (slots, found, rows))
        order = np.lexsort((row, ~score, slot))
        slot, score, row = slot[order], score[order], row[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.keep
        self.slot, self.score, self.id = slot[kept], score[kept], row[kept]
        full = place == self.keep - 1
        self.least[slot[full]] = score[full]

    def result(self) -> pa.RecordBatch:
        pairs = np.stack([self.ids[self.slot % max(len(self.ids), 1)], self.score, self.id])
        pairs = np.unique(pairs, axis=1) if pairs.shape[1] else pairs  # windows overlap
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["anchor", "score", "id"])


def _bounds(scores: pa.ListArray, low: int, high: int, windows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest score of each anchor's i-th window; an anchor without one gets an empty window."""
    out = [(np.full(len(scores), TOP), np.full(len(scores), -TOP)) for _ in range(windows)]
    for row, listed in enumerate(scores.to_pylist()):
        for i, score in enumerate(listed or ()):
            out[i][0][row], out[i][1][row] = -(-low * score // 100), high * score // 100
    return out


def _best_of_cells(cells: DataFrame, same: bool, keep: int, scale: int, low: int, high: int, windows: int) -> DataFrame:
    """The best ``keep`` rows of every cell for each anchor and window: (anchor, score, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, anchors, cell = None, [], None

        def opened() -> _Cell:
            table = pa.Table.from_batches(anchors).combine_chunks()
            column = lambda name: table.column(name).combine_chunks()
            anything = [(np.full(len(table), -TOP), np.full(len(table), TOP))]
            bounds = anything if same else _bounds(column("scores"), low, high, windows)
            ids, labels = (column(n).to_numpy(zero_copy_only=False) for n in ("id", "label"))
            return _Cell(ids, labels, _matrix(column("vector"), scale), bounds, same, keep)

        for batch in batches:
            key = np.asarray(batch.column("cell")) * 2 + np.asarray(batch.column("kind"))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if b > a and key[a] // 2 != current:
                    if cell is not None:
                        yield cell.result()
                    current, anchors, cell = key[a] // 2, [], None
                if b > a and key[a] % 2 == 0:
                    anchors.append(part)
                elif b > a and anchors:
                    cell = cell or opened()
                    cell.add(*(part.column(n).to_numpy(zero_copy_only=False) for n in ("id", "label")), _matrix(part.column("vector"), scale))
        if cell is not None:
            yield cell.result()

    return map_arrow(cells, run, "anchor long, score long, id long")


def _cells(vectors: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Every row beside every block of anchors and the other way round, anchors first in each cell."""
    row = F.pmod(F.xxhash64("id"), F.lit(row_blocks))
    block = F.pmod(F.xxhash64(F.lit("anchor"), "id"), F.lit(anchor_blocks))

    def spread(df: DataFrame, kind: int, cell: Column, scores: Column) -> DataFrame:
        return df.select(cell.alias("cell"), F.lit(kind).cast("long").alias("kind"), "id", "label", "vector", scores.alias("scores"))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    given = F.col("scores") if "scores" in anchors.columns else F.lit(None).cast("array<long>")
    dealt_anchors = spread(anchors.withColumn("_row", every(row_blocks)), 0, block * row_blocks + F.col("_row"), given)
    dealt_rows = spread(vectors.withColumn("_block", every(anchor_blocks)), 1, F.col("_block") * row_blocks + row, F.lit(None).cast("array<long>"))
    dealt = dealt_anchors.unionByName(dealt_rows).repartition(row_blocks * anchor_blocks, "cell")
    return dealt.sortWithinPartitions("cell", "kind")


def packed(anchor: int, score: int, negative: bool, id_: int) -> bytes:
    return struct.pack(KEY, anchor + TOP + 1, TOP - score, negative, id_ + TOP + 1)


def emitted(keys: Iterable[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Read sorted keys once and give (anchor, positive, rank, negative, both scores).

    Only the windows of one anchor are held. A positive comes before negatives of its
    own score, so a window is open before its first negative arrives.
    """
    current, windows = None, []
    for key in keys:
        anchor, down, negative, id_ = struct.unpack(KEY, key)
        score = TOP - down
        if anchor != current:
            current, windows = anchor, []
        if not negative:
            if len(windows) < positives:
                windows.append([id_ - TOP - 1, score, 0])
            continue
        for window in windows:
            positive, against, given = window
            if given < negatives and low * against <= 100 * score <= high * against:
                window[2] += 1
                yield anchor - TOP - 1, positive, given + 1, id_ - TOP - 1, against, score


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """The first negatives of each anchor and positive: (anchor_id, positive_id, rank, negative_id, both scores).

    ``rows`` is (id, label, vector), ``is_anchor`` a condition on the id. Rows with a null
    id, label, vector or component, or one that is not finite, take no part; rows that
    share an id are one. Shorter vectors are filled up with zeros; a score beyond 64 bits
    is the nearest long. Equal scores go by id. An empty table, or one without anchors,
    gives no rows.
    """
    vectors = stored(usable(rows))
    n, chosen = vectors.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    row_blocks, anchor_blocks = max(LEAST_BLOCKS, -(-n // ROWS)), max(1, -(-chosen // ANCHORS))
    anchors = vectors.filter(is_anchor)
    near = _best_of_cells(_cells(vectors, anchors, row_blocks, anchor_blocks), True, positives, scale, low, high, positives)
    # At most ``positives`` rows a block and anchor meet here.
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id")))
    near = stored(near.groupBy("anchor").agg(F.slice(order, 1, positives).alias("near")))
    with_scores = anchors.join(near.select(F.col("anchor").alias("id"), F.transform("near", lambda x: -x["down"]).alias("scores")), "id")
    far = _best_of_cells(_cells(vectors, with_scores, row_blocks, anchor_blocks), False, negatives, scale, low, high, positives)
    listed = near.select("anchor", F.explode("near").alias("x")).select("anchor", (-F.col("x.down")).alias("score"), "x.id", F.lit(False).alias("negative"))
    pairs = stored(listed.unionByName(far.withColumn("negative", F.lit(True))))
    keys = pairs.rdd.map(lambda r: (packed(r["anchor"], r["score"], r["negative"], r["id"]), None))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = keys.repartitionAndSortWithinPartitions(partitions, lambda key: zlib.crc32(key[:8]))
    mined = in_order.mapPartitions(lambda part: emitted((key for key, _ in part), positives, negatives, low, high))
    return rows.sparkSession.createDataFrame(mined, T._parse_datatype_string(MINED), verifySchema=False)


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label) for the anchors whose id is divisible by 50.

    Where the id is divisible by 7 the label first becomes (label + 1) % 10. See
    ``hard_negatives`` for nulls, ties, repeated ids and empty tables.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), moved.cast("long").alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


# With anchors and rows paired outright: for the small tables of a test.
OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM {embeddings}
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 positives AS (SELECT anchor_id, id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 mined AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM mined WHERE rank <= 3
"""
