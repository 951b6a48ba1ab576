"""Row and column cleaning: sentinels, casts, complete cases, range filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.functions import labels as L


def blank_sentinel(df: DataFrame, sentinel: str = "null") -> DataFrame:
    """Turn a sentinel text into NULL in every string column."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in text})


def to_numbers(df: DataFrame, columns: Iterable[str], type_name: str = "double") -> DataFrame:
    """Cast text to numbers; text that is not a number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(type_name) for c in columns})


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with a value in each listed column (every column if none listed)."""
    return df.dropna("any", subset=list(columns) if columns else None)


def drop_miscoded(df: DataFrame, columns: Sequence[str] = S.COORDINATES, code: float = 1) -> DataFrame:
    """Drop a row if any coordinate is the placeholder code or missing."""
    for c in columns:
        df = df.filter(F.col(c) != code)
    return df


def until(df: DataFrame, day: dt.date | str, column: str = "game_date") -> DataFrame:
    """Keep rows up to and including a date."""
    return df.filter(F.col(column) <= F.lit(day).cast("date"))


def within(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Keep rows inside every closed range; ``None`` leaves that end open."""
    for column, (low, high) in ranges.items():
        if low is not None:
            df = df.filter(F.col(column) >= low)
        if high is not None:
            df = df.filter(F.col(column) <= high)
    return df


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Drop rows whose value is listed; rows with a NULL value stay."""
    return df.filter(~L.is_in(F.col(column), values))


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last`` in table order."""
    names = df.columns
    lo, hi = names.index(first), names.index(last)
    return names[lo:hi + 1] if lo <= hi else names[hi:lo + 1][::-1]


def with_row_key(df: DataFrame, columns: Sequence[str], name: str = "row_key") -> DataFrame:
    """Add a record id computed from business columns.

    The id depends on the row alone, so it survives a repartition, a retry and a
    second read, which positional ids do not. The columns must identify a row.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    return df.withColumn(name, F.md5(F.concat_ws("|", *parts)))


def clean_extract(raw: DataFrame) -> DataFrame:
    """Typed batted-ball table from an all-text extract."""
    df = blank_sentinel(raw)
    df = to_numbers(df, S.IDS, "bigint")
    df = to_numbers(df, S.SMALL_INTS, "int")
    df = to_numbers(df, S.MEASURES, "double")
    return to_numbers(df, ["game_date"], "date")


def with_outcomes(df: DataFrame) -> DataFrame:
    """Add hit flag, hit type, run value, spray angle and fielding team."""
    return df.withColumns({
        "hit": L.hit_flag(F.col("events")),
        "hit_type": L.hit_type(F.col("events")),
        "hor_angle": L.horizontal_angle(F.col("hc_x"), F.col("hc_y")),
        "fielding_team": L.fielding_team(F.col("inning_topbot"), F.col("away_team"), F.col("home_team")),
    }).withColumn("run_value", L.run_value(F.col("hit_type")))


def with_pitch_labels(df: DataFrame) -> DataFrame:
    """Add count, pitch category, velocity band and batter-side labels."""
    return df.withColumns({
        "count": L.count_label(F.col("balls"), F.col("strikes")),
        "pitch_category": L.pitch_category(F.col("pitch_type")),
        "velocity_range": L.velocity_range(F.col("start_speed")),
        "stand_label": L.recode(F.col("stand"), S.STAND_LABELS),
    })


def modelling_rows(df: DataFrame) -> DataFrame:
    """Rows fit for modelling: all measures present, coordinates not miscoded."""
    return drop_miscoded(complete_cases(df, S.REQUIRED_MEASURES))
