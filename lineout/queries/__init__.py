"""Registered queries: every operator, run on tables derived from the test data."""

from lineout.queries import (  # noqa: F401  (importing registers)
    aggregates,
    derived,
    evaluation,
    joins,
    modelling,
    projection,
    sampling,
    sources,
    statistics,
)
from lineout.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
