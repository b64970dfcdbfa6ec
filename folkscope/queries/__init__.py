"""Registered queries over the test tables, each with its check in SQL where one exists."""

from folkscope.queries.registry import ORACLES, QUERIES

from folkscope.queries import (  # noqa: E402,F401  (importing registers)
    aggregates,
    columns,
    exactsums,
    factors,
    filters,
    formulas,
    frequent,
    inference,
    joins,
    layouts,
    models,
    profiles,
    reshaping,
    scalars,
    sketches,
    sources,
    windows,
)

__all__ = ["ORACLES", "QUERIES"]
