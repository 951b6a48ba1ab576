"""Find benchmark passages in documents: SimHash windows, multi-index Hamming search, exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineout.llm.common import WORD, lower_ascii, stored

SHINGLE = 5
SIMILARITY = 0.75
BLOCKS, NEAR = 8, 2  # 64 bits in 8 blocks; blocks are looked up with up to 2 bits changed
RADIUS = BLOCKS * (NEAR + 1) - 1  # within 23 bits, some block differs in 2 bits at most


def _grams(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    def one(i: Column) -> Column:
        parts = [part for j in range(size) for part in (F.get(words, i + j), F.lit("\n"))]
        return F.xxhash64(*parts)

    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), one))


def simhash(grams: Column) -> Column:
    """64-bit SimHash: bit b is set if most grams, counted with repeats, have bit b set."""
    def bit(total: Column, b: Column) -> Column:
        ones = F.aggregate(grams, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return total.bitwiseOR(F.when(2 * ones > F.size(grams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def _block(fingerprint: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, i * 8).bitwiseAND(F.lit(255).cast("long"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, grams, n_grams): size is SHINGLE, or the item's word count if it is shorter."""
    words = benchmark.select("item_id", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    words = words.filter(F.size("words") > 0).withColumn("size", F.least(F.lit(SHINGLE), F.size("words")))
    grams = F.coalesce(*[F.when(F.col("size") == k, _grams(F.col("words"), k)) for k in range(1, SHINGLE + 1)])
    return stored(words.select("item_id", "size", grams.alias("grams")).withColumn("n_grams", F.size("grams")))


def item_sized_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, size, n_grams, window, fingerprint, wid) of the windows that can match an item.

    A window that shares no shingle with an item of its length has similarity 0.
    A window whose first shingle is not the item's can move on by one word without
    losing similarity, so it is enough to begin windows at shared shingles, or at
    the last place where the window fits. Texts shorter than the item are one window.
    """
    wanted = stored(items.select("size", "n_grams", F.explode("grams").alias("gram")).distinct())
    sizes = sorted(row.size_ for row in items.select(F.col("size").alias("size_")).distinct().collect())  # at most SHINGLE
    words = docs.select("doc_id", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    parts = None
    for k in sizes or [SHINGLE]:
        part = words.select("doc_id", F.lit(k).alias("size"), _grams(F.col("words"), k).alias("doc_grams"))
        parts = part if parts is None else parts.unionByName(part)
    # The outer form keeps the planner from testing the list, and so making it, once more below.
    found = parts.select("doc_id", "size", "doc_grams", F.posexplode_outer("doc_grams").alias("at", "gram")).join(wanted, ["size", "gram"])
    start = F.least(F.col("at"), F.greatest(F.size("doc_grams") - F.col("n_grams"), F.lit(0)))
    windows = found.select("doc_id", "size", "n_grams", F.slice("doc_grams", start + 1, F.col("n_grams")).alias("window"))
    windows = stored(windows.withColumn("fingerprint", simhash(F.col("window"))))
    return windows.withColumn("wid", F.xxhash64("size", "n_grams", "window"))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Shared over joint weight of two shingle lists; a shingle weighs as often as it occurs."""
    def count(grams: Column, gram: Column) -> Column:
        return F.size(F.filter(grams, lambda g: g == gram))

    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g)))
    return shared / (F.size(a) + F.size(b) - shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, similarity (the best window's).

    Words are lower-cased (A-Z). An item is found if some window of as many words
    reaches ``similarity`` by weighted five-word shingles. Windows are compared by
    SimHash: each item is indexed under every value of each block within ``NEAR``
    bits, so every fingerprint within ``RADIUS`` bits is met, which a window at the
    limit exceeds with a chance below 1e-4. Equal windows, of many documents that
    share a passage, are looked up once.

    Null and empty texts and items match nothing; items of fewer than five words
    match whole. Rows that repeat an id give one result per id and item. Extra
    columns are ignored, and either table may be empty.
    """
    items = benchmark_items(benchmark)
    keyed = stored(items.withColumn("fingerprint", simhash(F.col("grams"))))
    windows = item_sized_windows(docs, items)
    flips = [0] + [1 << a for a in range(8)] + [1 << a | 1 << b for a in range(8) for b in range(a)]
    number = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    index = keyed.select("item_id", "size", "n_grams", F.col("fingerprint").alias("item_print"), number)
    index = index.withColumn("near", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])))
    index = index.withColumn("value", _block(F.col("item_print"), F.col("block")).bitwiseXOR(F.col("near"))).drop("near")
    unique = windows.groupBy("wid").agg(F.first("size").alias("size"), F.first("n_grams").alias("n_grams"), F.first("fingerprint").alias("fingerprint"))
    probes = unique.select("wid", "size", "n_grams", "fingerprint", number)
    probes = probes.withColumn("value", _block(F.col("fingerprint"), F.col("block")))
    near = probes.join(index, ["size", "n_grams", "block", "value"]).filter(
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS
    ).select("wid", "item_id").distinct()
    met = windows.select("doc_id", "wid", "window").join(near, "wid").join(keyed.select("item_id", "grams"), "item_id")
    scored = met.select("doc_id", "item_id", weighted_similarity(F.col("window"), F.col("grams")).alias("similarity"))
    return scored.filter(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)


OP3_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
items AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {benchmark}) WHERE len(w) > 0),
item_grams AS (SELECT item_id, k, len(w) - k + 1 AS m, array_to_string(w[i:i + k - 1], ' ') AS g
 FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM items),
doc_grams AS (SELECT r, k, n, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS g
 FROM (SELECT r, k, w, len(w) - k + 1 AS n, unnest(range(1, len(w) - k + 2)) AS i FROM low, sizes)),
starts AS (SELECT DISTINCT r, k, m, least(pos, greatest(n - m, 0)) AS s, least(n, m) AS n FROM doc_grams JOIN (SELECT DISTINCT k, m, g FROM item_grams) USING (k, g)),
windows AS (SELECT s.r, s.k, s.m, s.s, s.n, g, count(*) AS c FROM starts s JOIN doc_grams d ON s.r = d.r AND s.k = d.k AND d.pos >= s.s AND d.pos < s.s + s.m GROUP BY ALL),
counted AS (SELECT item_id, k, m, g, count(*) AS c FROM item_grams GROUP BY ALL),
shared AS (SELECT r, s, item_id, w.m, w.n, sum(least(w.c, i.c)) AS common FROM windows w JOIN counted i USING (k, m, g) GROUP BY ALL),
scored AS (SELECT doc_id, item_id, common::DOUBLE / (n + m - common)::DOUBLE AS similarity FROM shared JOIN low USING (r))
SELECT doc_id, item_id, max(similarity) AS similarity FROM scored WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""
