"""Joins.

No join carries an unconditional broadcast hint. The planner broadcasts a side
whose file size, or measured size at run time, is below the session's threshold,
and shuffles with skew handling otherwise. Only literal lookup tables, which
cannot grow with the data, are hinted.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_named(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    """Equi-join on differently named keys; the left name stays."""
    renamed = right.withColumnRenamed(right_key, left_key)
    return left.join(renamed, left_key, how)


def join_natural(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Equi-join on all shared column names."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which a missing key matches a missing key, as in grouped results."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])


def country_chain(films: DataFrame, countries: DataFrame, survey: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Film totals with country attributes (left), survey answers and culture scores (inner)."""
    joined = join_named(films, countries, key, "country", "left")
    joined = join_named(joined, survey, key, "country", "inner")
    return join_named(joined, scores, key, "country", "inner")


def left_join_sql(answers: DataFrame, countries: DataFrame, question: str) -> DataFrame:
    """The same left join written as SQL text with ``USING``."""
    return answers.sparkSession.sql(
        f"SELECT country, {question}, response, income_level FROM {{answers}} LEFT JOIN {{countries}} USING (country)",
        answers=answers,
        countries=countries,
    )
