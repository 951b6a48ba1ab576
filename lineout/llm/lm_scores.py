"""Score documents by cross-entropy difference of two n-gram language models.

Texts are cut into parts as they lie. Each part asks once for every distinct word and
pair that it has: the hashes go in order, as steps from one to the next, to the bucket
that their upper bits name, with the part's own counts. A bucket adds the counts up and
answers in the order of the question, without a key, and the part scores its texts. What
is moved grows with the distinct words and pairs of the parts, not with the occurrences,
and a word that is met often is one entry of a part like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout.llm.common import Buckets, map_arrow, stored
from lineout.llm.words import BLOCK_BYTES, blocks, mixed, packed, steps, unpacked, unsteps, words

BACKOFF = 2.0  # weight of the unigram chance in a bigram estimate
PART_WORDS = 1 << 19  # words of text that a task sorts and counts at once
BUCKETS, BUCKET_WORDS = 256, 1 << 21  # words of text are asked for in buckets of about this size at most, and so many at least
UNIT = 2.0**32  # losses are summed as integers of this fraction, so that no order of rows changes a sum

_BEGIN = np.uint64(0xB5297A4D)
_PARTS = "part long, n long, ids array<long>, sizes binary, distinct long, words binary, places binary"
_ASKED = "bucket int, part long, asked array<binary>"
_ANSWERED = "part long, bucket int, answer array<binary>"
_SCORED = "doc_id long, n long, background long, target long"


@dataclass
class Part:
    """Words of some rows in their order."""

    sizes: np.ndarray  # words of each row
    words: np.ndarray  # distinct, sorted
    place: np.ndarray  # of each word of the rows among them
    last: np.ndarray  # no word after
    pairs: np.ndarray  # distinct, sorted
    pair: np.ndarray  # place of each word's pair among them

    @classmethod
    def of(cls, row: dict) -> Part:
        sizes, place = unpacked(row["sizes"], len(row["ids"])).astype(np.int64), unpacked(row["places"], row["n"]).astype(np.int64)
        found = unsteps(row["words"], row["distinct"])
        ends = np.cumsum(sizes)[sizes > 0]
        last = np.zeros(len(place), bool)
        last[ends - 1] = True
        hashes = found[place]
        before = np.full(len(place), _BEGIN, np.uint64)
        before[1:] = np.where(last[:-1], _BEGIN, hashes[:-1])
        pairs, pair = np.unique(mixed(mixed(before) + hashes), return_inverse=True)
        return cls(sizes, found, place, last, pairs, pair)


def _cutter(part_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [field.split()[0] for field in _PARTS.split(", ")]

    def made(part: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        found = words(batch.column("text"))
        distinct, place = np.unique(found.hashes, return_inverse=True)
        ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id").cast(pa.int64()))
        sizes = packed(np.bincount(found.row, minlength=batch.num_rows))
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(place)]), ids, *map(pa.array, ([sizes], [len(distinct)], [steps(distinct)], [packed(place)]))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in parts of about ``part_words`` words: their ids, and the place of each word among the distinct ones."""
        held, size, part = [], 0, TaskContext.get().partitionId() << 32
        for batch in blocks(batches, limit=min(BLOCK_BYTES, 6 * part_words)):
            held.append(batch)
            size += batch.column("text").nbytes // 6
            if size >= part_words:
                yield made(part, held)
                held, size, part = [], 0, part + 1
        if held:
            yield made(part, held)

    return cut


def _by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin in a sorted table, and the end."""
    bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _asker(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per bucket: the part's words there and how often each is met and ends a text, in all rows and in
        those of the target; its pairs and how often each is met. Every bucket is asked, for its totals."""
        for row in _rows(batches):
            if not row["n"]:
                continue
            part = Part.of(row)
            good = np.zeros(len(part.sizes), bool)
            good[row["good"] or []] = True
            good = np.repeat(good, part.sizes)
            asked = []
            for hashes, at, uses in ((part.words, part.place, (slice(None), good, part.last, part.last & good)), (part.pairs, part.pair, (slice(None), good))):
                counts, cuts = [np.bincount(at[use], minlength=len(hashes)) for use in uses], _by_bucket(hashes, buckets)
                asked.append([[(b - a).tobytes(), steps(hashes[a:b]), *(packed(c[a:b]) for c in counts)] for a, b in zip(cuts, cuts[1:])])
            listed = pa.array([w + p for w, p in zip(*asked)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, row["part"])), listed], ["bucket", "part", "asked"])

    return ask


def _added_up(questions: list[list[bytes]]) -> tuple[list[list[bytes]], list[int]]:
    """Each question's hashes with their counts in all questions; the number of distinct ones and the sum of each count."""
    sizes = [int(np.frombuffer(q[0], np.int64)[0]) for q in questions]
    distinct, at = np.unique(np.concatenate([unsteps(q[1], n) for q, n in zip(questions, sizes)]), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([unpacked(q[i], n) for q, n in zip(questions, sizes)]), len(distinct)).astype(np.int64) for i in range(2, len(questions[0]))]
    cuts = np.cumsum([0, *sizes])
    return [[packed(s[at[a:b]]) for s in sums] for a, b in zip(cuts, cuts[1:])], [len(distinct), *(int(s.sum()) for s in sums)]


def _answered(bucket: int, held: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
    about_words, totals = _added_up([asked[:6] for _, asked in held])
    about_pairs, _ = _added_up([asked[6:] for _, asked in held])
    totals = np.array(totals).tobytes()
    listed = pa.array([[totals, *w, *p] for w, p in zip(about_words, about_pairs)], pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([part for part, _ in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), listed], ["part", "bucket", "answer"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of one bucket after another."""
    held, now = [], None
    for row in _rows(batches):
        if held and row["bucket"] != now:
            yield _answered(now, held)
            held = []
        now = row["bucket"]
        held.append((row["part"], row["asked"]))
    if held:
        yield _answered(now, held)


def _fixed(loss: np.ndarray | float) -> np.ndarray:
    return np.rint(loss * UNIT).astype(np.int64)


def _scorer(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def losses(part: Part, answers: list[list[bytes]]) -> Iterator[np.ndarray]:
        """Of the background's and the target's model: the loss of each row that has a word."""
        vocabulary, *totals = np.sum([np.frombuffer(a[0], np.int64) for a in answers], 0)
        sizes = [np.diff(_by_bucket(hashes, buckets)) for hashes in (part.words, part.pairs)]
        counts = [np.concatenate([unpacked(a[i], n) for a, n in zip(answers, sizes[i > 4])]).astype(np.int64) for i in range(1, 7)]
        word = np.zeros(len(part.pairs), np.int64)
        word[part.pair] = part.place
        ends = np.cumsum(part.sizes)[part.sizes > 0]
        for side in (0, 1):
            n, n_last, n_pair = counts[side], counts[2 + side], counts[4 + side]
            loss = _fixed(-np.log(n_pair + BACKOFF * ((n[word] + 1.0) / (totals[side] + vocabulary))))[part.pair]
            loss += np.where(part.last, 0, _fixed(np.log(n - n_last + BACKOFF))[part.place])
            yield np.add.reduceat(loss, np.concatenate([[0], ends[:-1]])) + _fixed(np.log(totals[2 + side] + BACKOFF))  # one last word for each text

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            part = Part.of(row)
            sums = np.zeros((2, len(part.sizes)), np.int64)
            if row["n"]:
                sums[:, part.sizes > 0] = [*losses(part, [a["answer"] for a in sorted(row["answers"], key=lambda a: a["bucket"])])]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *map(pa.array, (part.sizes, *sums))], ["doc_id", "n", "background", "target"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, part_words: int = PART_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, mean loss per word under both models, and their difference.

    The target model is learned from all documents labelled quality 1, the
    background from all documents. Both are bigram models, backed off to words,
    over the vocabulary of all documents: words and pairs are told apart by 64-bit
    hashes, and every one is counted. Texts stay in their parts; their distinct words and
    pairs meet by hash, and only ids are joined with the labels. Null and
    empty texts have no words and all values 0. Repeated rows give repeated
    results; an empty table gives none. Without a labelled row the target model is uniform.
    """
    dealt = Buckets(docs.sparkSession, "part")
    parts = dealt.stored(map_arrow(docs.select("doc_id", "text"), _cutter(part_words), _PARTS))
    buckets = max(buckets, -(-(parts.agg(F.sum("n").alias("n")).first().n or 0) // BUCKET_WORDS))
    wanted = labels.filter("quality = 1").select("doc_id").dropna().distinct()
    good = parts.select("part", F.posexplode("ids").alias("row", "doc_id")).join(wanted, "doc_id").select("part", "row")
    marked = parts.join(dealt.listed(good, "good", "row"), "part", "left")
    asked = map_arrow(marked, _asker(buckets), _ASKED).repartitionById(dealt.count, "bucket").sortWithinPartitions("bucket")
    answers = dealt.listed(map_arrow(asked, _answer, _ANSWERED), "answers", F.struct("bucket", "answer"))
    sums = stored(map_arrow(parts.join(answers, "part", "left"), _scorer(buckets), _SCORED))
    dealt.drop()
    mean = {side: F.col(side) / F.lit(UNIT) / F.greatest("n", F.lit(1)) for side in ("target", "background")}
    return sums.select(
        "doc_id", F.col("n").alias("n_words"), mean["target"].alias("target_loss"), mean["background"].alias("background_loss"),
        (mean["target"] - mean["background"]).alias("loss_difference"),
    )


def op10_lm_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, labels)
