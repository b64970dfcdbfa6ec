"""Stacking, wide and long forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkscope.fixed_values import MIN_FILMS_EXCLUSIVE
from folkscope.functions.numbers import round_even
from folkscope.operators.missing import drop_text_na
from folkscope.session import materialise

MISSING_LEVEL = "NA"
MAX_LEVELS = 1000


def bounded_levels(df: DataFrame, columns: list[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct values of category columns, from one pass over all of them.

    At most ``max_levels`` values per column reach the driver; a column with more
    is refused, since a wide table or a set of dummies over it makes no sense.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    found = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.c", "p.v")
        .filter("v IS NOT NULL")
        .distinct()
        .limit(max_levels * len(columns) + 1)
        .collect()
    )
    levels = {c: sorted(row.v for row in found if row.c == c) for c in columns}
    if len(found) > max_levels * len(columns):
        raise ValueError(f"columns {columns} have together more than {max_levels} levels each")
    for column, values in levels.items():
        if len(values) > max_levels:
            raise ValueError(f"column {column} has more than {max_levels} levels")
    return levels


def stack(frames: list[DataFrame], fill_missing: bool = False) -> DataFrame:
    """Rows of all tables, duplicates kept; columns are matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), frames)


def pivot_wide(
    df: DataFrame,
    id_cols: list[str],
    names_from: str,
    values_from: str,
    names: list[str] | dict[str, str] | None = None,
    unlisted: str = "error",
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """One column per level.

    ``names`` lists the levels, or maps each level to its column name, so columns
    are named by value and never by position. What becomes of a level that is not
    listed says ``unlisted``: ``error`` stops the query, ``drop`` leaves it out. Without
    ``names`` the levels are looked up; more than ``max_levels`` of them are refused, as
    each would be a column. A missing level becomes the column ``NA``. If a cell has
    several values, the largest is kept. Cells are reduced and written before their
    levels are looked up, so the input is read once.
    """
    if unlisted not in ("error", "drop"):
        raise ValueError("unlisted is 'error' or 'drop'")
    level = F.coalesce(F.col(names_from).cast("string"), F.lit(MISSING_LEVEL))
    keyed = df.select(*id_cols, level.alias("_level"), F.col(values_from).alias("_value"))
    if names is None:
        keyed = materialise(keyed.groupBy(*id_cols, "_level").agg(F.max("_value").alias("_value")), "cells")
        names = bounded_levels(keyed, ["_level"], max_levels)["_level"]
    elif unlisted == "error":
        listed = F.col("_level").isin(list(names))
        refused = F.raise_error(F.concat(F.lit(f"{names_from} has a level that is not listed: "), F.col("_level")))
        keyed = keyed.withColumn("_level", F.when(listed, F.col("_level")).otherwise(refused.cast("string")))
    if not isinstance(names, dict):
        names = {n: n for n in names}
    wide = keyed.groupBy(*id_cols).pivot("_level", list(names)).agg(F.max("_value"))
    return wide.withColumnsRenamed(names)


def pivot_long(df: DataFrame, keep: list[str], name: str, value: str) -> DataFrame:
    """All columns but ``keep`` as name and value rows, nulls included."""
    columns = [c for c in df.columns if c not in keep]
    return df.unpivot(keep, columns, name, value)


def records_wide(df: DataFrame, id_col: str, attribute: str, value: str, order: list[str], attributes: list[str]) -> DataFrame:
    """Attribute/value rows to one record per id; a repeated attribute keeps its first value."""
    first = F.min_by(value, F.struct(*order))
    return df.groupBy(id_col).pivot(attribute, attributes).agg(first)


def level_profile(
    df: DataFrame,
    row: str,
    level: str,
    levels: list[str] | None = None,
    min_total_exclusive: int = MIN_FILMS_EXCLUSIVE,
) -> DataFrame:
    """Percent of every level in each row group, as a complete grid in long form.

    The total of a group counts all its rows, those without a level and those of levels
    that are not listed too; ``levels`` only chooses the cells. Groups at or below the
    threshold leave, absent levels count zero. Rows are counted before anything else, so
    a group is at most one row per level, and the levels to be shown join the groups as
    one array: there is no limit to their number.
    """
    labelled = df.select(F.col(row).alias("_row"), F.coalesce(F.col(level).cast("string"), F.lit(MISSING_LEVEL)).alias("_level"))
    counts = materialise(labelled.groupBy("_row", "_level").agg(F.count(F.lit(1)).alias("_n")), "counts")
    kept = counts.groupBy("_row").agg(F.sum("_n").alias("_total")).filter(F.col("_total") > min_total_exclusive)
    shown = F.lit(levels) if levels is not None else counts.agg(F.array_sort(F.collect_set("_level"))).scalar()
    grid = kept.select(F.col("_row").alias("_r"), "_total", F.explode(shown).alias("_l"))
    cells = grid.join(counts, F.col("_r").eqNullSafe(F.col("_row")) & (F.col("_l") == F.col("_level")), "left")
    percent = round_even(100 * F.coalesce("_n", F.lit(0)) / F.col("_total"), 2)
    return cells.select(F.col("_r").alias(row), F.col("_l").alias(level), percent.alias("perc"))


def level_matrix(profile: DataFrame, row: str, level: str, levels: list[str]) -> DataFrame:
    """The percent grid with one column per level."""
    return pivot_wide(profile, [row], level, "perc", levels, unlisted="drop")


def heatmap_cells(profile: DataFrame, row: str, level: str, rows: DataFrame) -> DataFrame:
    """Grid cells of the rows kept in another table, without the missing level."""
    kept = profile.join(rows.select(row).distinct(), row, "left_semi")
    return drop_text_na(kept, level)
