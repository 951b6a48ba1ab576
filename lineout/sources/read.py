"""Reading raw extracts and tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineout import schema as S


def read_extracts(spark: SparkSession, path: str | list[str], keep_corrupt: bool = False) -> DataFrame:
    """All raw CSV extracts under a folder, as text columns.

    The schema is declared, so nothing is scanned to infer types. A malformed
    line is kept, with its text in ``_corrupt_record`` if ``keep_corrupt``.
    """
    fields = list(S.RAW_SCHEMA.fields)
    if keep_corrupt:
        fields.append(T.StructField(S.CORRUPT_COLUMN, T.StringType()))
    return (
        spark.read.schema(T.StructType(fields))
        .option("header", True).option("nullValue", "null").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", S.CORRUPT_COLUMN)
        .csv(path)
    )


def read_database(
    spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int], **options: str,
) -> DataFrame:
    """Result of a query on a remote database, read in parts.

    ``partition`` is (column, low, high, parts): that many tasks each read a range.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    column, low, high, parts = partition
    return (
        reader.option("dbtable", f"({query}) q").option("partitionColumn", column)
        .option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
    )


def first_day(season: int) -> Column:
    """A season's first day, to compare dates with where the scan can use it."""
    return F.lit(datetime.date(season, 1, 1))


def season_batters(pitches: DataFrame, season: int) -> DataFrame:
    """Batters with a ball in play in a season, with the season attached."""
    return (
        pitches.filter((F.col("game_date") >= first_day(season)) & (F.col("game_date") < first_day(season + 1)) & F.col("des2").ilike("in play%"))
        .select("batter").distinct().withColumn("year", F.lit(season))
    )


def balls_in_play(pitches: DataFrame, ordered: bool = False) -> DataFrame:
    """Pitches put in play. Order them, by batter and row, only when writing a file for reading."""
    hits = pitches.filter(F.col("type") == "X")
    return hits.orderBy("batter") if ordered else hits


def latest_per_key(df: DataFrame, key: str, value: str, order: str, after_season: int | None = None) -> DataFrame:
    """One value per key: that of the latest row, the largest value on a tie."""
    if after_season is not None:
        df = df.filter(F.col(order) >= first_day(after_season + 1))
    return df.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value))
