"""Phrase collocations by set-oriented mining over stored occurrence relations.

The relation of phrases of k words holds an occurrence as (chunk, place, phrase) in
order of place. Chunks are whole runs of text, dealt to buckets when the first relation
is written, so that every join by chunk reads its buckets as they lie. A pass counts the
phrases of each chunk, adds the counts up by phrase, joins the frequent ones back to
their chunks and stores what is left; phrases of k + 1 words are then the merge join of
that relation with itself, moved by one place. Beyond single words, a chunk asks for its
distinct phrases by hash bucket, sorted and packed, and the answers come in the same order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineout.llm.common import LOWER, UPPER, Buckets, map_arrow, stored
from lineout.llm.words import mixed, packed, steps, unpacked, unsteps

# A word, or a run that ends a piece.
TOKEN = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
ENDS = re.compile(r"[.,;:!?\x0A-\x0D]")
UNKNOWN = "und"
CHUNK = 1 << 21  # places of a chunk, or as many more as its last piece has
CHUNK_BITS, PHRASE_BITS = 14, 26  # chunks of a task, and phrases of a chunk; an id packs task, chunk and phrase
LONG_TEXT, RUN = 1 << 22, 1 << 16
LEAST, MOST_WORDS, COVERED, TOP = 10, 3, 50, 2000  # COVERED in percent
SALTS = 32
OUT_ROWS = 1 << 16

CHUNKS = "chunk long, langs array<string>, words array<string>, counts array<long>, numbers binary"
# Whether a phrase begins at each place (bits), the phrases there as numbers into ``ids``.
RELATION = "chunk long, n long, places binary, phrases binary, ids array<long>"
ASKED = "bucket int, chunk long, asked array<binary>"
# An answer to a chunk, or a bucket's frequent phrases with a null chunk.
ANSWERED = "chunk long, bucket int, answer array<binary>, found array<struct<id: long, a: long, left: long, right: long>>"
FOUND = pa.list_(pa.struct([(c, pa.int64()) for c in ("id", "a", "left", "right")]))
BUCKETS, BUCKET_PLACES = 256, 1 << 21  # so many buckets at least, and one for so many words of text


class _Numbers(dict):
    """Numbers words of one language in the order they come; ends of pieces are -1."""

    def __init__(self, lang: str, words: list[tuple[str, str]]):
        self.lang, self.words = lang, words

    def __missing__(self, token: str) -> int:
        if ENDS.match(token):
            self[token] = -1
        else:
            self[token] = len(self.words)
            self.words.append((self.lang, token))
        return self[token]


def _tokens(text: str) -> Iterator[list[str]]:
    """Words and ends of pieces of a text; a long one in runs."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    if len(text) <= LONG_TEXT:
        yield TOKEN.findall(text)
        return
    found = TOKEN.finditer(text)
    while tokens := [m.group() for m in islice(found, RUN)]:
        yield tokens


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut texts into chunks: the words of each with language and count, and the number of the word at each place.

    A place without a word, number -1, ends a piece. Chunks end where pieces do.
    """
    chunk, words, langs, held, size = TaskContext.get().partitionId() << CHUNK_BITS, [], {}, [], 0

    def made() -> pa.RecordBatch:
        numbers = np.concatenate(held)
        counts = np.bincount(numbers[numbers >= 0], minlength=len(words))
        listed = (pa.array([w[0] for w in words], pa.string()), pa.array([w[1] for w in words], pa.string()), pa.array(counts, pa.int64()))
        rows = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), values) for values in listed]
        return pa.RecordBatch.from_arrays([pa.array([chunk]), *rows, pa.array([numbers.tobytes()])], ["chunk", "langs", "words", "counts", "numbers"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            lang = UNKNOWN if lang is None else lang
            for tokens in (*_tokens(text or ""), ["."]):
                if lang not in langs:
                    langs[lang] = _Numbers(lang, words)
                held.append(np.fromiter(map(langs[lang].__getitem__, tokens), np.int32, len(tokens)))
                size += len(tokens)
                if size >= CHUNK and held[-1][-1] == -1:
                    yield made()
                    chunk, words, langs, held, size = chunk + 1, [], {}, [], 0
    if size:
        yield made()


@contextmanager
def _chunk_by_chunk(spark):
    """Hand chunks to the workers one at a time: a chunk is large, and a batch of rows would hold many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _places(row: dict) -> np.ndarray:
    """The phrase at every place of a stored relation, -1 for none."""
    full = np.full(row["n"], -1, np.int64)
    full[np.unpackbits(np.frombuffer(row["places"], np.uint8), count=row["n"]).astype(bool)] = np.frombuffer(row["phrases"], np.int32)
    return full


def _longer(full: np.ndarray, phrases: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a relation with itself at the next place: places, each one's group, the groups' codes and counts."""
    at = np.flatnonzero((full[:-1] >= 0) & (full[1:] >= 0))
    codes, group, counts = np.unique(full[at] * phrases + full[at + 1], return_inverse=True, return_counts=True)
    return at, group, codes, counts


def _relation_row(chunk: int, full: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    begins = full >= 0
    values = [[chunk], [len(full)], [np.packbits(begins).tobytes()], [full[begins].astype(np.int32).tobytes()]]
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, values), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64()))],
        ["chunk", "n", "places", "phrases", "ids"],
    )


def _relation(row: dict, size: int, at: np.ndarray, phrase: np.ndarray, kept: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Semi-join of the phrases at some places with the ``kept`` ones of ``size``, which are numbered in order of id."""
    order = np.argsort(ids)
    number = np.full(size, -1, np.int64)
    number[kept[order]] = np.arange(len(kept))
    full = np.full(row["n"], -1, np.int64)
    full[at] = number[phrase]
    return _relation_row(row["chunk"], full, ids[order])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One chunk at a time; lists stay Arrow arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield {name: value if name in ("ids", "kept") else value.as_py() for name, value in row.items()}


def _keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        numbers, kept = np.frombuffer(row["numbers"], np.int32), row["kept"].values
        at = np.flatnonzero(numbers >= 0)
        yield _relation(row | {"n": len(numbers)}, int(numbers.max(initial=-1)) + 1, at, numbers[at], kept.field("phrase").to_numpy(), kept.field("id").to_numpy())


def _dealt(ids: np.ndarray, codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's phrases in order of bucket, then of the ids of their two parts: the order, both ids, and the buckets that
    have any with the places where each begins, and the end."""
    left, right = (ids[x] for x in np.divmod(codes, max(1, len(ids))))
    hashes = mixed(mixed(left.astype(np.uint64)) + right.astype(np.uint64)) >> np.uint64(32)
    bucket = (hashes * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, begins = np.unique(bucket[order], return_index=True)
    return order, left[order], right[order], own, np.append(begins, len(order))


def _asker(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's phrases of one word more: the ids of their two parts and their count, one row per bucket."""
        for row in _rows(batches):
            ids = row["ids"].values.to_numpy()
            _, _, codes, counts = _longer(_places(row), len(ids))
            order, left, right, own, cuts = _dealt(ids, codes, buckets)
            counts = counts[order]
            asked = [[(b - a).tobytes(), steps(left[a:b].astype(np.uint64)), packed(right[a:b]), packed(counts[a:b])] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), row["chunk"])), pa.array(asked, pa.list_(pa.binary()))], ["bucket", "chunk", "asked"])

    return ask


def _answerer(buckets: int, least: int, back: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["chunk", "bucket", "answer", "found"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which of the phrases asked for are frequent and the place of each among the bucket's (``back``); the bucket's frequent phrases."""
        for batch in batches:
            for bucket, questions in zip(batch.column("bucket").to_pylist(), batch.column("questions")):
                chunks, asked = zip(*(q.values() for q in questions.as_py()))
                sizes = [int(np.frombuffer(q[0], np.int64)[0]) for q in asked]
                left = np.concatenate([unsteps(q[1], n) for q, n in zip(asked, sizes)])
                right, n = (np.concatenate([unpacked(q[i], n) for q, n in zip(asked, sizes)]) for i in (2, 3))
                order = np.lexsort((right, left))
                left, right = left[order].astype(np.int64), right[order].astype(np.int64)
                new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
                first = np.flatnonzero(new)
                a = np.add.reduceat(n[order].astype(np.int64), first)
                frequent = a >= least
                place = np.cumsum(frequent) - 1
                if back:
                    same = np.empty(len(order), np.int64)
                    same[order] = np.cumsum(new) - 1
                    cuts = np.cumsum([0, *sizes])
                    answers = []
                    for b, e in zip(cuts, cuts[1:]):
                        use = frequent[same[b:e]]
                        answers.append([np.packbits(use).tobytes(), use.sum().tobytes(), steps(place[same[b:e][use]].astype(np.uint64))])
                    yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), pa.array(answers, pa.list_(pa.binary())), pa.nulls(len(chunks), FOUND)], names)
                found = pa.StructArray.from_arrays([place[frequent] * buckets + bucket, a[frequent], left[first][frequent], right[first][frequent]], ["id", "a", "left", "right"])
                for b in range(0, len(found), OUT_ROWS):
                    some = found[b : b + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), pa.nulls(1, pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)], names)

    return answer


def _keeper(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Join of a relation with itself, and semi-join of what comes out with the frequent phrases."""
        for row in _rows(batches):
            ids = row["ids"].values.to_numpy()
            at, group, codes, _ = _longer(_places(row), len(ids))
            order, _, _, own, cuts = _dealt(ids, codes, buckets)
            use, found = [], []
            for x, n in zip(sorted(row["answers"], key=lambda x: x["bucket"]), np.diff(cuts)):
                frequent, some, places = x["answer"]
                use.append(np.unpackbits(np.frombuffer(frequent, np.uint8), count=n).astype(bool))
                found.append(unsteps(places, int(np.frombuffer(some, np.int64)[0])).astype(np.int64) * buckets + x["bucket"])
            yield _relation(row, len(codes), at, group, order[np.concatenate(use)], np.concatenate(found))

    return keep


def _counted(groups: DataFrame, keys: list[str], least: int) -> DataFrame:
    """A chunk's frequent phrases with their ids and counts; the keys stand only in one row of each id.

    A phrase's id is the least (chunk, phrase) that it has. A key meets once per chunk.
    """
    same = W.partitionBy(*keys)
    summed = groups.withColumns({"a": F.sum("n").over(same), "id": F.min("own").over(same)})
    first = F.col("own") == F.col("id")
    chunk, phrase = F.shiftright("own", PHRASE_BITS), F.col("own").bitwiseAND((1 << PHRASE_BITS) - 1).cast("int")
    return stored(summed.filter(F.col("a") >= least).select(
        chunk.alias("chunk"), phrase.alias("phrase"), "id", F.when(first, F.col("a")).alias("a"), *[F.when(first, F.col(k)).alias(k) for k in keys],
    ))


def _phrases(counted: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """One row per phrase: its words, and the counts of its beginnings and ends by length."""
    found = counted.filter("a IS NOT NULL").drop("chunk", "phrase")
    if shorter is None:
        return stored(found.select("id", "a", "lang", F.array("word").alias("words"), F.array("a").alias("heads"), F.array("a").alias("tails")))
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("words").alias("_before"), F.col("heads").alias("_heads"))
    right = shorter.select(F.col("id").alias("right"), F.element_at("words", -1).alias("_last"), F.col("tails").alias("_tails"))
    both = found.join(left, "left").join(right, "right")
    return stored(both.select(
        "id", "a", "lang", F.array_append("_before", F.col("_last")).alias("words"), F.array_append("_heads", F.col("a")).alias("heads"),
        F.array_append("_tails", F.col("a")).alias("tails"), "left", "right",
    ))


def _scored(phrases: DataFrame, longer: DataFrame | None, words: int, covered: int) -> DataFrame:
    """Score at the lowest cut, without the phrases that a longer one covers."""
    whole = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    cut = lambda k: F.struct(
        F.expr(f"({whole(1000000)} * {whole('a')} * {whole('a')}) div ({whole(f'heads[{k - 1}]')} * {whole(f'tails[{words - k - 1}]')})").cast("long").alias("score"),
        F.lit(k).alias("k"), F.col("heads")[k - 1].alias("l"), F.col("tails")[words - k - 1].alias("r"),
    )
    scored = phrases.withColumn("cut", F.array_min(F.array(*[cut(k) for k in range(1, words)])) if words > 2 else cut(1))
    if longer is not None:
        around = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("_around"))
        around = around.groupBy("id").agg(F.max("_around").alias("_around"))
        scored = scored.join(around, "id", "left").filter(F.coalesce(100 * F.col("_around") < covered * F.col("a"), F.lit(True)))
    return scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, covered: int = COVERED, top: int = TOP,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``most_words`` words of every language (lang, rank, phrase, a, l, r, n, score).

    ``docs`` has text and lang; a null language counts as ``und``, a null or empty text
    has no words, repeated rows count as often as they stand. Equal scores go by count,
    then by the phrase's bytes. An empty table gives no rows. A piece is held whole, and a
    phrase meets once per chunk: nothing else grows in one task.
    """
    buckets = Buckets(docs.sparkSession, "chunk")
    chunks = buckets.stored(map_arrow(docs.select("lang", "text"), _chunks, CHUNKS))
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("phrase", "x"))
    own = F.shiftleft("chunk", PHRASE_BITS).bitwiseOR(F.col("phrase").cast("long"))
    words = listed.select(own.alias("own"), F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    kept = _counted(words, ["lang", "word"], least)
    levels = [_phrases(kept, None)]
    many = max(BUCKETS, (totals.agg(F.sum("n").alias("n")).first().n or 0) // BUCKET_PLACES)
    with _chunk_by_chunk(docs.sparkSession):
        beside = chunks.select("chunk", "numbers").join(buckets.listed(kept, "kept", F.struct("phrase", "id")), "chunk")
        relation = buckets.stored(map_arrow(beside, _keep_words, RELATION))
        for length in range(2, most_words + 1):
            back = length < most_words  # else nothing is joined back any more
            asked = map_arrow(relation, _asker(many), ASKED).repartition(buckets.count, "bucket")
            asked = asked.groupBy("bucket").agg(F.collect_list(F.struct("chunk", "asked")).alias("questions"))
            answers = stored(map_arrow(asked, _answerer(many, least, back), ANSWERED))
            levels.append(_phrases(answers.filter("chunk IS NULL").select(F.inline("found")), levels[-1]))
            if back:
                listed = buckets.listed(answers.filter("chunk IS NOT NULL"), "answers", F.struct("bucket", "answer"))
                relation = buckets.stored(map_arrow(relation.join(listed, "chunk"), _keeper(many), RELATION))
    buckets.drop()
    scored = None
    for length, (phrases, longer) in enumerate(zip(levels, [*levels[1:], None]), 1):
        if length > 1:
            some = _scored(phrases, longer, length, covered)
            scored = some if scored is None else scored.unionByName(some)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(documents: DataFrame) -> DataFrame:
    """Collocations of 2 and 3 words of all ``documents``; see ``collocations`` for odd rows."""
    return collocations(documents)


# Every phrase of every piece is laid out: for the small tables of a test.
OP13_SQL = r"""
WITH pieces AS (SELECT lang, row_number() OVER () AS piece, words FROM (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM (
   SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM {documents}))),
 places AS (SELECT lang, piece, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM pieces),
 three AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM places WINDOW o AS (PARTITION BY piece ORDER BY i)),
 f AS (SELECT lang, 1 AS k, w AS p, NULL AS head, NULL AS tail, NULL AS first, NULL AS last, count(*) AS n FROM three GROUP BY ALL
  UNION ALL SELECT lang, 2, concat_ws(' ', w, w2), w, w2, w, w2, count(*) FROM three WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, concat_ws(' ', w, w2, w3), concat_ws(' ', w, w2), concat_ws(' ', w2, w3), w, w3, count(*)
   FROM three WHERE w3 IS NOT NULL GROUP BY ALL),
 c AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
 sides AS (SELECT lang, k, p, n AS a, 1 AS j, first AS left_part, tail AS right_part FROM c
  UNION ALL SELECT lang, k, p, n, 2, head, last FROM c WHERE k = 3),
 total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
 cut AS (SELECT s.*, l.n AS l, r.n AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM sides s JOIN f l ON l.lang = s.lang AND l.p = s.left_part JOIN f r ON r.lang = s.lang AND r.p = s.right_part),
 scored AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
 around AS (SELECT lang, p, max(n) AS a FROM (SELECT lang, head AS p, n FROM c WHERE k = 3
  UNION ALL SELECT lang, tail, n FROM c WHERE k = 3) GROUP BY ALL),
 kept AS (SELECT s.lang, s.p AS phrase, s.a, s.l, s.r, s.score FROM scored s
  LEFT JOIN around o ON s.k = 2 AND o.lang = s.lang AND o.p = s.p WHERE o.a IS NULL OR 100 * o.a < 50 * s.a),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(total.n AS BIGINT) AS n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
