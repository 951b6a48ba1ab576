"""Mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineout.llm.common import stored, word_count

BUCKETS = 4096
BINS = 16384


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: tuple[int, int], passes: int) -> DataFrame:
    """One row per source of (source, source_size): its rank, target and the budget.

    Sources by code point, null last, take the weights in turn. The budget is a
    fraction (numerator, denominator) of all sizes, shared by weight; a target
    stops at ``passes`` times its source's size and the excess is shared again.
    That ends at one level L with target = min(passes * size, L * weight), found
    here from running sums over the sources in the order in which they fill up.
    """
    everywhere, by_name = W.partitionBy(F.lit(0)), W.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    listed = listed.withColumns({
        "weight": F.col("weight").cast("double"), "cap": (F.col("source_size") * passes).cast("double"),
        "budget": F.floor(F.sum("source_size").over(everywhere) * budget[0] / F.lit(budget[1])).cast("long"),
    })
    filling = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    after = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The first source, in filling order, that the level does not fill fixes the level for all.
    listed = listed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    fixed = F.min_by("level", F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(everywhere)
    target = F.least(F.col("cap"), F.coalesce(fixed * F.col("weight"), F.col("cap")))
    return listed.select("source", "rank", "source_size", "budget", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget: tuple[int, int] = (3, 2),
    passes: int = 2,
    seed: str = "mix",
    size: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, its shuffle ``key``, and the columns to ``keep``.

    Each source's documents are shuffled by md5 of seed and id. A document's
    virtual finish time is the source's words up to its end divided by the
    source's target, in every pass over the source. All passes of all documents
    stand in one order of finish time (source rank, then shuffle order, break
    ties) and are cut where the budget is used up; the document at the cut gives
    the part that is left. ``taken`` counts what all passes give.

    Sums are integers and the order depends on no partitioning, so reruns agree.
    A source is dealt over ``BUCKETS`` ranges of the shuffle key, so a hot one
    fills no task. Null texts have size 0 and give nothing; a null source is a
    source of its own; rows that repeat an id are separate entries; rows equal in
    id and size are interchangeable. An empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    counted = word_count(F.col("text")) if size is None else size
    sized = stored(docs.select("doc_id", "source", counted.alias("size"), key.alias("key"), *keep))
    # Three hex digits are 4096 even ranges of the key.
    bucketed = sized.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, passes)
    plan = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        offsets["source"].alias("p_source"), F.col("bucket").alias("p_bucket"), "offset", "rank", "source_size", "target", "budget",
    )
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = bucketed.withColumn("upto", F.sum("size").over(inside)).join(
        plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket"))
    )
    placed = stored(placed.select(
        "doc_id", "key", "size", "source_size", "target", "budget", "rank", (F.col("offset") + F.col("upto")).alias("upto"), *keep,
    ))

    def finish(turn: Column | int) -> Column:
        words = F.col("upto") + F.lit(turn) * F.col("source_size") if isinstance(turn, int) else F.col("upto") + turn * F.col("source_size")
        return F.try_divide(words.cast("double"), F.col("target"))

    # Fixed ranges of finish time find the cut: whole ranges are summed, one range is sorted.
    turns = placed.filter("size > 0").withColumn("turn", F.explode(F.array(*map(F.lit, range(passes)))))
    entries = turns.select("rank", "size", "budget", finish(F.col("turn")).alias("finish"))
    entries = entries.withColumn("bin", F.least(F.floor(F.col("finish") * (BINS // 4)), F.lit(BINS)))
    per_bin = entries.groupBy("bin").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    upto = F.sum("words").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    cut_bin = per_bin.withColumn("upto", upto).filter(F.col("upto") >= F.col("budget"))
    cut_bin = cut_bin.agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("cut")).select("cut").scalar()
    at_cut = entries.filter(F.col("bin") == cut_bin["bin"])
    in_bin = W.partitionBy("bin").orderBy("finish", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    at_cut = at_cut.withColumn("upto", cut_bin["before"] + F.sum("size").over(in_bin)).filter(F.col("upto") >= F.col("budget"))
    last = at_cut.agg(F.min(F.struct("finish", "rank", (F.col("budget") - F.col("upto") + F.col("size")).alias("part"))).alias("last"))
    last = last.select("last").scalar()

    def given(turn: int) -> Column:
        mine, end = F.struct(finish(turn).alias("finish"), F.col("rank")), F.struct(last["finish"].alias("finish"), last["rank"].alias("rank"))
        return F.when(F.col("size") == 0, 0).when(mine < end, F.col("size")).when(mine == end, last["part"]).otherwise(0)

    taken = sum((given(turn) for turn in range(1, passes)), given(0)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "key", *keep)


def op9_mix_sources(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
 SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
 FROM {documents}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
listed AS (
 SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
  CAST(floor(sum(source_size) OVER () * 3 / 2) AS BIGINT) AS budget FROM sources),
weighed AS (
 SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM listed),
levels AS (
 SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
fixed AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
targets AS (
 SELECT source, rank, source_size, budget, least(cap, coalesce((SELECT level FROM fixed) * weight, cap)) AS target FROM weighed),
placed AS (
 SELECT doc_id, key, size, source_size, target, budget, rank,
  CAST(sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
 FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
entries AS (
 SELECT placed.*, CAST(upto + turn * source_size AS DOUBLE) / target AS finish, row_number() OVER () AS entry
 FROM placed, (VALUES (0), (1)) AS t(turn) WHERE size > 0),
taken AS (
 SELECT doc_id, key, size, rank, upto,
  greatest(0, least(size, budget - sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) + size)) AS part FROM entries),
summed AS (SELECT doc_id, key, size, rank, upto, CAST(sum(part) AS BIGINT) AS taken FROM taken GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(s.taken, 0) AS taken
FROM placed p LEFT JOIN summed s ON p.size > 0 AND p.doc_id IS NOT DISTINCT FROM s.doc_id AND p.rank = s.rank AND p.upto = s.upto
"""
