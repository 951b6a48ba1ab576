"""Samples, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineout import schema as S
from lineout.operators import features, sampling
from lineout.queries.registry import query, r6, rounded

_HASHED = """hashed AS (SELECT row_key, stand, split_of.h,
 row_number() OVER (ORDER BY split_of.h) AS rk, count(*) OVER () AS total,
 row_number() OVER (PARTITION BY stand ORDER BY split_of.h) AS rk_s, count(*) OVER (PARTITION BY stand) AS total_s
 FROM (SELECT row_key, stand, md5('42|' || row_key) AS h FROM balls) split_of)"""


@query("m1_exact_sample", f"WITH {_HASHED} SELECT row_key, stand FROM hashed WHERE rk <= round_even(0.25 * total, 0)")
def _(t):
    return sampling.exact_sample(t.balls.select("row_key", "stand"), 0.25)


@query("m1_bernoulli_sample", f"""
WITH {_HASHED} SELECT row_key, stand FROM hashed
WHERE CAST('0x' || substr(h, 1, 8) AS BIGINT) < 0.25 * 4294967296""")
def _(t):
    return sampling.exact_sample(t.balls.select("row_key", "stand"), 0.25, exact=False)


@query("m2_stratified_sample", f"""
WITH {_HASHED} SELECT row_key, stand FROM hashed WHERE rk_s <= round_even(0.25 * total_s, 0)""")
def _(t):
    return sampling.stratified_sample(t.balls.select("row_key", "stand"), "stand", 0.25)


@query("m2_stratified_by_batter", """
SELECT row_key, batter FROM (SELECT row_key, batter,
 row_number() OVER (PARTITION BY batter ORDER BY md5('42|' || row_key)) AS rk, count(*) OVER (PARTITION BY batter) AS n
 FROM balls) WHERE rk <= round_even(0.15 * n, 0)""")
def _(t):
    return sampling.stratified_sample(t.balls.select("row_key", "batter"), "batter", 0.15)


@query("m3_three_way_split", "SELECT row_key, split FROM split")
def _(t):
    return t.split.select("row_key", "split")


@query("m4_out_of_training", "SELECT row_key, split FROM split WHERE split <> 'train'")
def _(t):
    return sampling.out_of_training(t.split).select("row_key", "split")


_COLUMNS = S.SCALED


@query("f1_fit_scale", "SELECT " + ", ".join(
    f"round(avg({c}), 6) AS center_{c}, round(stddev_samp({c}), 6) AS scale_{c}" for c in _COLUMNS
) + " FROM split WHERE split = 'train'")
def _(t):
    parameters = features.scale_parameters(t.split.filter(F.col("split") == "train"))
    return rounded(parameters, *parameters.columns)


@query("f2_apply_scale", """
WITH f AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _COLUMNS) + """
 FROM split WHERE split = 'train')
SELECT row_key, split, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _COLUMNS) + """
FROM split, f WHERE split <> 'train'""")
def _(t):
    parameters = features.scale_parameters(t.split.filter(F.col("split") == "train"))
    rest = sampling.out_of_training(t.split)
    return features.apply_scale(rest, parameters).select("row_key", "split", *[r6(c).alias(c) for c in _COLUMNS])
