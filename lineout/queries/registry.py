"""Where each query stands next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineout.queries.fixture import PRELUDE, Tables

# A mean whose seventh decimal ends in 5 may differ in its last bit between two
# engines, or two runs, and then rounds to either side. Both engines therefore
# round the value moved up by this much, far below the precision compared.
NUDGE = 1e-9

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` may read the prelude's stages.

    ``round(x, 6)`` in the SQL is the counterpart of ``r6``.
    """

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            body = sql.strip().replace(", 6)", f" + {NUDGE}, 6)")
            joined = "," + body[len("WITH"):] if body.upper().startswith("WITH") else body
            _SQL[name] = PRELUDE + joined
        return fn

    return add


def r6(column: Column | str) -> Column:
    """Round for comparison: float sums differ in the last bits between engines."""
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(NUDGE), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
