"""Grouped aggregates with the missing-value rules of survey work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folkscope.operators.joins import null_safe_join
from folkscope.session import materialise


def strict_sum(col: Column | str) -> Column:
    """Sum that is null as soon as one input is null; Spark's own skips nulls."""
    return F.when(F.count(F.lit(1)) == F.count(col), F.sum(col))


def strict_mean(col: Column | str) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(col), F.avg(col))


def weighted_counts(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    return df.groupBy(*by).agg(strict_sum(weight).alias("weighted_n"))


def weighted_shares(df: DataFrame, group: str, answer: str, weight: str = "weight") -> DataFrame:
    """Weighted count, group size and share of every answer within its group.

    The rows are summed per (group, answer) first, with a partial sum before the
    shuffle, so a group holding most rows reaches the window as one row per answer.
    """
    counts = weighted_counts(df, [group, answer], weight)
    whole = Window.partitionBy(group)
    return counts.withColumn("weighted_group_size", _strict_over("weighted_n", whole)).withColumn(
        "weighted_estimate", F.col("weighted_n") / F.col("weighted_group_size")
    )


def _strict_over(column: str, window) -> Column:
    complete = F.count(F.lit(1)).over(window) == F.count(column).over(window)
    return F.when(complete, F.sum(column).over(window))


def attach_group_total(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Group total on every row.

    A window would send each group to a single task. Here the totals are summed
    with partial aggregation, written, and joined back: the planner sees the size
    of the written table and broadcasts it when small; otherwise the join shuffles
    and adaptive execution splits a hot group.
    """
    totals = df.groupBy(*by).agg(strict_sum(value).alias(name))
    return null_safe_join(df, materialise(totals, "totals"), by)


def summarise_across(
    df: DataFrame,
    by: list[str],
    functions: dict[str, Callable[[str], Column]],
    columns: list[str] | None = None,
) -> DataFrame:
    """Every function on every column, results named ``column_function``."""
    columns = columns or [c for c in df.columns if c not in by]
    cells = [fn(c).alias(f"{c}_{label}") for c in columns for label, fn in functions.items()]
    return df.groupBy(*by).agg(*cells)


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def stacked_share(df: DataFrame, bar: str, level: str) -> DataFrame:
    """Share of each level in its bar, by row count."""
    counts = df.groupBy(bar, level).agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy(bar))
    return counts.withColumn("share", F.col("n") / size)


def majority(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Rows with the largest measure of their group, ties kept.

    ``df`` has one row per (group, answer). The rank filter lets Spark keep only
    the candidates of each input partition before the shuffle.
    """
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(measure))
    return df.withColumn("_rank", F.rank().over(order)).filter("_rank = 1").drop("_rank")


def maximum(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Largest value per group, null as soon as one input is null."""
    complete = F.count(F.lit(1)) == F.count(column)
    return df.groupBy(*by).agg(F.when(complete, F.max(column)).alias(column))


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and share per column from one pass."""
    columns = columns or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counts.unpivot("_rows", columns, "feature", "num_missing").select(
        "feature", "num_missing", (F.col("num_missing") / F.col("_rows")).alias("pct_missing")
    )
