"""Exact, repeatable samples and splits without a global sort.

Rows are ordered by ``md5("<seed>|<key>")``, so membership depends on the key
alone: not on partitioning, retries or cluster size. To find the row at an exact
rank, rows are counted per hash prefix (65 536 buckets whatever the table size),
the bucket holding the rank is found on those counts, and only that bucket, one
65 536th of the rows, is sorted. The rows themselves are then kept or dropped by
comparing their hash with the hash found: a filter, with no shuffle of the table.

The key must be unique. If two rows share the hash at a cut, no exact cut
exists, and the query fails instead of returning a sample of the wrong size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.operators.joins import null_safe_join
from lineout.sources.write import materialise

PREFIX_LENGTH = 4  # hex digits: 65 536 buckets
_HASH, _PREFIX, _BITS = "_hash", "_prefix", "_bits"


def order_hash(key: str, seed: int = S.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def share_of(share: float) -> Callable[[Column], Column]:
    """Rows to take from a total: the share rounded half to even."""
    return lambda total: F.bround(total * F.lit(share)).cast("bigint")


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    hashed = df.withColumn(_HASH, order_hash(key, seed))
    return hashed.withColumn(_PREFIX, F.substring(_HASH, 1, PREFIX_LENGTH))


def _bucket_counts(hashed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per (group, prefix), rows up to and including it, rows in the group."""
    group = W.partitionBy(*by)
    upto = group.orderBy(_PREFIX).rowsBetween(W.unboundedPreceding, 0)
    return (
        hashed.groupBy(*by, _PREFIX).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(group))
    )


def _hash_at_rank(hashed: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hash of the row at a wanted rank inside its bucket.

    ``edges`` holds (by..., prefix, need) and other columns; the result adds
    ``_limit``. Only rows of those buckets are ranked.
    """
    keys = [*by, _PREFIX]
    bucket = null_safe_join(hashed.select(*keys, _HASH), edges, keys, "inner")
    ranked = W.partitionBy(*keys, "_need").orderBy(_HASH)
    tied = F.lead(_HASH).over(ranked) == F.col(_HASH)
    bucket = bucket.select("*", F.row_number().over(ranked).alias("_rank"), tied.alias("_tied"))
    failure = F.raise_error(F.lit("row key is not unique: no exact sample exists"))
    at = bucket.filter(F.col("_rank") == F.col("_need"))
    return at.withColumn("_limit", F.when(F.col("_tied"), failure).otherwise(F.col(_HASH)))


def _cut_hashes(hashed: DataFrame, sizes: Sequence[Callable[[Column], Column]]) -> Column:
    """Struct column ``c0, c1, ...``: the last hash inside each cumulative size."""
    cuts = F.array(*[
        F.struct(F.lit(i).alias("cut"), size(F.col("_total")).alias("k"))
        for i, size in enumerate(sizes)
    ])
    edges = (
        _bucket_counts(hashed, []).withColumn("_cut", F.explode(cuts))
        .filter((F.col("_upto") - F.col("_n") < F.col("_cut.k")) & (F.col("_cut.k") <= F.col("_upto")))
        .select(_PREFIX, "_cut.cut", (F.col("_cut.k") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    # At most one row per cut, so at most len(sizes) rows are broadcast.
    limits = _hash_at_rank(hashed, F.broadcast(edges), [])
    return limits.select(F.struct(*[
        F.max(F.when(F.col("cut") == i, F.col("_limit"))).alias(f"c{i}") for i in range(len(sizes))
    ])).scalar()


def exact_sample(
    df: DataFrame, share: float, key: str = "row_key", seed: int = S.SEED, exact: bool = True,
) -> DataFrame:
    """Sample ``round(share * n)`` rows without replacement.

    ``exact=False`` keeps each row with probability ``share`` in one pass, still
    decided by the key's hash alone.
    """
    if not exact:
        return df.filter(F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10).cast("double") < share * 2.0**32)
    hashed = _hashed(df, key, seed)
    limit = _cut_hashes(hashed.select(_HASH, _PREFIX), [share_of(share)])
    return hashed.filter(F.col(_HASH) <= limit["c0"]).drop(_HASH, _PREFIX)


def stratified_sample(
    df: DataFrame, by: Sequence[str] | str, share: float, key: str = "row_key", seed: int = S.SEED,
) -> DataFrame:
    """Sample ``round(share * n)`` rows within each group.

    Rows meet their group's cut through (group, hash prefix), a key that stays
    evenly spread however few or uneven the groups are.
    """
    by = [by] if isinstance(by, str) else list(by)
    hashed = _hashed(df, key, seed)
    slim = hashed.select(*by, _HASH, _PREFIX)
    take = share_of(share)(F.col("_total"))
    buckets = _bucket_counts(slim, by).withColumn("_need", take - F.col("_upto") + F.col("_n"))
    keys = [*by, _PREFIX]
    edges = buckets.filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_n"))).select(*keys, "_need")
    limits = _hash_at_rank(slim, edges, by).select(*keys, "_limit")  # one row per group
    inside = F.col(_HASH) <= F.col("_limit")
    whole = buckets.filter(F.col("_need") > F.col("_n")).select(*keys, F.lit("g").alias("_limit"))
    kept = null_safe_join(hashed, whole.unionByName(limits), keys, "left_semi", inside)
    return kept.drop(_HASH, _PREFIX)


def _three_way_sizes(train: float, test_of_rest: float) -> list[Callable[[Column], Column]]:
    def upto_test(total: Column) -> Column:
        first = share_of(train)(total)
        return first + share_of(test_of_rest)(total - first)

    return [share_of(train), upto_test]


def three_way_split(
    df: DataFrame,
    train: float = S.TRAIN_SHARE,
    test_of_rest: float = S.TEST_SHARE_OF_REST,
    key: str = "row_key",
    seed: int = S.SEED,
    name: str = "split",
) -> DataFrame:
    """Label rows train / test / validate.

    Train takes its share of all rows, test its share of the rest, validate what
    remains; every row gets exactly one label.
    """
    hashed = _hashed(df, key, seed)
    cut = _cut_hashes(hashed.select(_HASH, _PREFIX), _three_way_sizes(train, test_of_rest))
    label = (
        F.when(F.col(_HASH) <= cut["c0"], "train")
        .when(F.col(_HASH) <= cut["c1"], "test")
        .otherwise("validate")
    )
    return hashed.withColumn(name, label).drop(_HASH, _PREFIX)


def stored_three_way_split(
    df: DataFrame,
    train: float = S.TRAIN_SHARE,
    test_of_rest: float = S.TEST_SHARE_OF_REST,
    key: str = "row_key",
    seed: int = S.SEED,
    name: str = "split",
) -> DataFrame:
    """``three_way_split`` of a table that is stored with it, for readers that come back.

    The rows are computed and written once, next to the first 60 bits of their hash; the
    cuts are found on what is stored, and a reader compares its rows' bits with them.
    """
    hashed = order_hash(key, seed)
    bits = F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")
    rows = materialise(df.withColumn(_BITS, bits))
    prefix = F.lpad(F.hex(F.shiftright(_BITS, 44)), PREFIX_LENGTH, "0")
    cuts = _cut_hashes(rows.select(hashed.alias(_HASH), prefix.alias(_PREFIX)), _three_way_sizes(train, test_of_rest))
    cut = rows.sparkSession.range(1).select(cuts.alias("cut")).first()["cut"] or {"c0": None, "c1": None}

    def inside(limit: str | None) -> Column:
        if limit is None:
            return F.lit(False)
        at = int(limit[:15], 16)
        return (F.col(_BITS) < at) | ((F.col(_BITS) == at) & (hashed <= limit))

    label = F.when(inside(cut["c0"]), "train").when(inside(cut["c1"]), "test").otherwise("validate")
    return rows.withColumn(name, label).drop(_BITS)


def out_of_training(df: DataFrame, name: str = "split") -> DataFrame:
    return df.filter(F.col(name) != "train")


def split_sizes(df: DataFrame, name: str = "split") -> DataFrame:
    """Rows per split next to the rows of the whole table."""
    sizes = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("total", df.agg(F.count(F.lit(1)).alias("n")).scalar())
