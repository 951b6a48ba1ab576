"""Samples and splits: exact sizes, repeatable membership, no lost rows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lineout.operators import joins, sampling


def frame(spark, n, group=lambda i: "a"):
    return spark.createDataFrame([(f"k{i}", group(i)) for i in range(n)], "row_key string, g string")


def keys(df):
    return {r["row_key"] for r in df.collect()}


def by_hash(names, seed=42):
    return sorted(names, key=lambda k: hashlib.md5(f"{seed}|{k}".encode()).hexdigest())


@pytest.mark.parametrize(("n", "share"), [(10, 0.15), (10, 0.25), (1, 0.25), (777, 0.15), (5000, 0.5), (30, 1.0), (30, 0.0)])
def test_sample_is_the_first_rows_in_hash_order(spark, n, share):
    want = by_hash([f"k{i}" for i in range(n)])[:round(n * share)]
    assert keys(sampling.exact_sample(frame(spark, n), share)) == set(want)


def test_sample_does_not_depend_on_partitioning_but_on_the_seed(spark):
    df = frame(spark, 500)
    first = keys(sampling.exact_sample(df.repartition(1), 0.2))
    assert first == keys(sampling.exact_sample(df.repartition(7), 0.2))
    assert first != keys(sampling.exact_sample(df, 0.2, seed=7))


def test_repeated_key_at_the_cut_is_an_error_not_a_wrong_size(spark):
    df = spark.createDataFrame([("same",)] * 10, "row_key string")
    with pytest.raises(Exception, match="not unique"):
        sampling.exact_sample(df, 0.5).collect()


def test_stratified_sample_takes_its_share_of_each_group(spark):
    sizes = {"a": 400, "b": 37, "c": 1, None: 10}
    rows = [(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "row_key string, g string")
    got = sampling.stratified_sample(df, "g", 0.25)
    want = {k for g, n in sizes.items() for k in by_hash([f"{g}{i}" for i in range(n)])[:round(n * 0.25)]}
    assert keys(got) == want


def test_split_is_disjoint_complete_and_of_exact_size(spark):
    df = sampling.three_way_split(frame(spark, 1003))
    counts = {r["split"]: r["n"] for r in sampling.split_sizes(df).collect()}
    train = round(1003 * 0.15)
    assert counts == {"train": train, "test": round((1003 - train) * 0.5), "validate": 1003 - train - round((1003 - train) * 0.5)}
    assert df.count() == 1003 and df.select("row_key").distinct().count() == 1003
    rest = sampling.out_of_training(df)
    assert keys(rest) == keys(joins.drop_keys(df, df.filter(F.col("split") == "train")))


def test_approximate_sample_is_near_its_share(spark):
    n = sampling.exact_sample(frame(spark, 5000), 0.25, exact=False).count()
    assert abs(n - 1250) < 150


def test_salted_lookup_equals_plain_lookup(spark):
    df = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(300)], "i int, batter int")
    heights = spark.createDataFrame([(1, 72.0), (3, 70.0)], "batter int, h double")
    plain = sorted(map(str, joins.lookup_join(df, heights, "batter").select("i", "batter", "h").collect()))
    salted = sorted(map(str, joins.lookup_join(df, heights, "batter", salts=5).select("i", "batter", "h").collect()))
    assert plain == salted and len(plain) == 300
