"""Conditional columns with the missing-value rules of survey work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def either(condition: Column, yes, no) -> Column:
    """Two-way choice; an unknown condition gives null, not the second value."""
    return F.when(condition, yes).when(~condition, no)


def member_of(col: Column | str, values: list) -> Column:
    """Set membership where a missing value is simply not a member."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).isin(values), F.lit(False))


def member_flag(col: Column | str, values: list) -> Column:
    return F.when(member_of(col, values), 1).otherwise(0)


def ladder(*branches: tuple[Column, object]) -> Column:
    """Multi-way choice, null when no branch holds."""
    (condition, value), *rest = branches
    column = F.when(condition, value)
    for condition, value in rest:
        column = column.when(condition, value)
    return column
