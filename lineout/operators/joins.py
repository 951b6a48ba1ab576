"""Joins and set operations by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineout import schema as S

CELL = 0.5  # feet: zones are looked up by the square cell a pitch lies in
CELLS = 64  # cells to either side; what lies further out shares the outermost


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, salts: int = 1) -> DataFrame:
    """Left join to a table with one row per key.

    No broadcast is forced: the lookup grows with the number of keys, so the
    planner decides from its real size. With ``salts > 1`` each lookup row is
    repeated per salt and a hot key is spread over that many tasks; the salt
    comes from the row itself, so a retried task sends rows to the same place.
    """
    if salts <= 1:
        return df.join(lookup, key, "left")
    salt = "_salt"
    spread = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return salted.join(spread, [key, salt], "left").drop(salt)


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", extra: Column | None = None,
) -> DataFrame:
    """Equi-join where a missing key matches a missing key.

    ``extra`` may add a condition on columns whose names are unique to one side.
    """
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    terms = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    on = reduce(Column.__and__, terms if extra is None else [*terms, extra])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def restore_columns(df: DataFrame, source: DataFrame, columns: Sequence[str], key: str = "row_key") -> DataFrame:
    """Replace columns by their values in another table, matched on the key."""
    return df.drop(*columns).join(source.select(key, *columns), key, "left")


def keep_keys(df: DataFrame, keys: DataFrame, key: str = "row_key") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, key: str = "row_key") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def append(*frames: DataFrame) -> DataFrame:
    """Stack tables, matching columns by name."""
    return reduce(DataFrame.unionByName, frames)


def _stacked(tables: Sequence[pd.DataFrame | Mapping[str, Sequence]]) -> pd.DataFrame:
    """Tables of a few rows as one. Mappings are strung together by column: a frame of its own costs more than its rows."""
    if any(isinstance(t, pd.DataFrame) for t in tables):
        return pd.concat([t if isinstance(t, pd.DataFrame) else pd.DataFrame(t) for t in tables])
    return pd.DataFrame({c: list(chain.from_iterable(t[c] for t in tables)) for c in tables[0]})


def apply_per_key(
    keys: DataFrame, fn: Callable[..., pd.DataFrame | Mapping[str, Sequence]], schema: str, rows: int = 10_000,
) -> DataFrame:
    """Call a table-returning function once per row of a key table.

    ``fn`` takes the key columns and returns a frame, or a mapping of columns to lists of
    one length, which is much faster where tables are small. Keys are made distinct
    first, and each task streams through its share of them: results are passed
    on whenever about ``rows`` rows have gathered.
    """
    names = keys.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for row in batch[names].itertuples(index=False):
                table = fn(*row)
                held.append(table)
                size += len(table) if isinstance(table, pd.DataFrame) else len(next(iter(table.values()), ()))
                if size >= rows:
                    yield _stacked(held)
                    held, size = [], 0
        if held:
            yield _stacked(held)

    # Keys are few bytes but each may be much work: spread them over all cores.
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.distinct().repartition(cores).mapInPandas(run, schema)


def zone_code(
    df: DataFrame,
    zones: DataFrame,
    height: str | None = None,
    reference_height: float = 72.0,
    cell: float = CELL,
) -> DataFrame:
    """Label each pitch with the first zone of the batter's side that holds it.

    ``zones`` has columns stand, x_lo, x_hi, z_lo, z_hi, label. A zone is listed
    under every cell it touches, one list per side and cell, so pitches meet the
    few zones of their own cell by an equi-join that never multiplies them. With
    ``height`` the vertical edges are scaled by the batter's height. Overlaps
    resolve to the zone that sorts first by an ``ord`` column if there is one,
    else by label and edges.
    """
    order = ["ord"] if "ord" in zones.columns else []
    entry = F.struct(*order, "label", "x_lo", "x_hi", "z_lo", "z_hi")

    def place(value: Column) -> Column:
        return F.greatest(F.lit(-CELLS), F.least(F.lit(CELLS), F.floor(value / cell))).cast("int")

    def touched(low: str, high: str) -> Column:
        # One cell more on either side, for edges that scaling moves by a rounding error.
        first, last = place(F.col(low)) - 1, place(F.col(high)) + 1
        return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array()))

    cells = zones.withColumn("_cx", touched("x_lo", "x_hi")).withColumn("_cz", touched("z_lo", "z_hi"))
    lists = cells.groupBy("stand", "_cx", "_cz").agg(F.sort_array(F.collect_list(entry)).alias("_zones"))
    scale = F.lit(1.0) if height is None else F.col(height) / reference_height
    x, z = F.col("px"), F.col("pz")

    def holds(zone):
        return x.between(zone["x_lo"], zone["x_hi"]) & z.between(zone["z_lo"] * scale, zone["z_hi"] * scale)

    first = F.try_element_at(F.filter(F.col("_zones"), holds), F.lit(1))["label"]
    return (
        df.withColumns({"_cx": place(x), "_cz": place(z / scale)}).join(lists, ["stand", "_cx", "_cz"], "left")
        .withColumn("location", F.coalesce(first, F.lit(S.OUT_OF_ZONE)))
        .select(*df.columns, "location")
    )


def default_zones(spark) -> DataFrame:
    rows = [(i, *zone) for i, zone in enumerate(S.DEFAULT_ZONES)]
    return spark.createDataFrame(rows, "ord int, " + S.ZONE_SCHEMA)
