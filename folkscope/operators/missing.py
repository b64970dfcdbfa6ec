"""Filters, missing values and row selection by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folkscope.session import materialise


def sentinel_to_null(df: DataFrame, columns: list[str], sentinel: str = "") -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def drop_text_na(df: DataFrame, column: str, text: str = "NA") -> DataFrame:
    """Drop rows whose text is the literal ``NA``; missing values go with them."""
    return df.filter(F.col(column) != text)


def observations(df: DataFrame, measure: str, age: str, period: str) -> DataFrame:
    """One measure of an observation table, for one age group and period."""
    wanted = (F.col("MEASURE") == measure) & (F.col("AGE") == age) & (F.col("obsTime") == period)
    return df.filter(wanted).select("LOCATION", "obsValue").toDF("Location", measure)


def split_by_level(df: DataFrame, column: str, levels: list[str], stored: bool = False) -> dict[str, DataFrame]:
    """One subset per named level.

    Plainly, each is a filter that reaches the scan. When several subsets of a
    derived table are used, ``stored`` writes the table once, one folder per level,
    and each subset then reads its own folder only.
    """
    if stored:
        df = materialise(df, "levels", partition_by=column)
    return {level: df.filter(F.col(column) == level) for level in levels}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def by_position(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns by 1-based position; all negative positions drop instead of keep."""
    if all(p < 0 for p in positions):
        dropped = {-p for p in positions}
        positions = [i for i in range(1, len(df.columns) + 1) if i not in dropped]
    return df.select(*[df.columns[p - 1] for p in positions])
