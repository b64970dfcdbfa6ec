"""Numeric columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(col: Column | str, digits: int = 0) -> Column:
    """Round half to even.

    ``F.round`` rounds half up. ``F.bround`` works on the printed decimal of a double,
    which makes ties of values that are none in binary, and builds a decimal per row;
    scaling and ``rint`` stay on doubles and decide by the stored value.
    """
    scale = float(10**digits)
    return F.rint(_col(col) * scale) / scale


def thousands(col: Column | str) -> Column:
    return round_even(_col(col) / 1000, 2)


def log_odds(col: Column | str) -> Column:
    p = _col(col)
    return F.ln(p / (1 - p))


def row_sum(cols: list[str]) -> Column:
    """Sum across columns, missing values skipped."""
    return reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in cols])


def extrapolate(yes: Column | str, no: Column | str, neutral: Column | str, population: Column | str) -> Column:
    """Scale a survey count to a population; a missing neutral count is zero."""
    yes, no = _col(yes), _col(no)
    total = yes + no + F.coalesce(_col(neutral), F.lit(0.0))
    return yes * (_col(population) / total)


def fixed_bin(col: Column | str, edges: list[float]) -> Column:
    """Label of the half-open bin ``[a,b)`` a value falls in, null outside all bins."""
    value = _col(col)
    ladder = None
    for low, high in zip(edges, edges[1:]):
        inside = value >= low if high == float("inf") else (value >= low) & (value < high)
        label = F.lit(f"[{low:g},{'Inf' if high == float('inf') else format(high, 'g')})")
        ladder = F.when(inside, label) if ladder is None else ladder.when(inside, label)
    return ladder


def min_max_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    """Position of each value in the column's range.

    The range is a scalar subquery: one aggregate over the pruned column, read as
    a constant by the main scan, so there is neither a cross join nor a window.
    """
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    low, high = span.getField("lo"), span.getField("hi")
    return df.withColumn(name, (F.col(column) - low) / F.nullif(high - low, F.lit(0.0)))


def number_sequence(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """``start, start+step, …, stop`` counted on integers, so no drift adds up."""
    steps = round((stop - start) / step)
    return spark.range(steps + 1).select((F.lit(start) + F.col("id") * step).alias("value"))
