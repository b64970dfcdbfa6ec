"""Row positions, top rows and level order, none of them through a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folkscope.session import materialise

_POSITION_BITS = 33


def row_index(df: DataFrame, order_by: list[str | Column], name: str = "index", start: int = 1) -> DataFrame:
    """Number all rows in a stated order.

    Rows are range-partitioned and sorted, each keeps its partition and position,
    and that is written to the scratch folder so both stay fixed. A count per
    partition, read from the small partition column alone, gives the offsets. The
    offset table has one row per partition and is broadcast. A per-row tie mark in
    the range key lets equal keys spread over several partitions.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    marked = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = marked.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    staged = materialise(
        ranged.drop("_tie").withColumns(
            {
                "_part": F.spark_partition_id(),
                "_pos": F.monotonically_increasing_id().bitwiseAND((1 << _POSITION_BITS) - 1),
            }
        ),
        "ordered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    position = (F.col("_offset") + F.col("_pos") + start).alias(name)
    return staged.join(F.broadcast(offsets), "_part").select(position, *df.columns)


def level_index(df: DataFrame, level: str, order_by: list[str | Column], name: str = "index") -> DataFrame:
    """Number the rows of every level in a stated order, from 1.

    All rows are numbered level after level, and each level's first number is taken off;
    a level that holds most rows is sorted by many tasks, unlike in a window. The first
    numbers are written before they are joined: a few levels are broadcast then, so rows
    are not dealt by level, and the join of many levels can split those that hold most rows.
    """
    numbered = materialise(row_index(df, [level, *order_by], "_index"), "numbered")
    first = numbered.groupBy(F.col(level).alias("_level")).agg(F.min("_index").alias("_first"))
    first = materialise(first, "first-numbers")
    joined = numbered.join(first, F.col(level).eqNullSafe(F.col("_level")))
    return joined.select((F.col("_index") - F.col("_first") + 1).alias(name), *df.columns)


def drop_positions(df: DataFrame, order_by: list[str | Column], positions: list[int]) -> DataFrame:
    """Remove rows by 1-based position in a stated order."""
    return row_index(df, order_by, "_index").filter(~F.col("_index").isin(positions)).drop("_index")


def bind_columns(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Put two tables side by side by position in their stated orders."""
    a = row_index(left, left_order, "_index")
    b = row_index(right, right_order, "_index")
    return a.join(b, "_index", "inner").drop("_index")


def top_n_ties(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n largest values and everything equal to the last of them.

    The bound comes from a distributed top-n of the single column, then a plain
    filter keeps the ties, however many there are.
    """
    top = df.select(column).filter(F.col(column).isNotNull()).orderBy(F.desc(column)).limit(n)
    return df.filter(F.col(column) >= top.agg(F.min(column)).scalar())


def order_levels(df: DataFrame, level: str, measure: str) -> DataFrame:
    """Levels numbered by the mean of a measure, ties by name."""
    means = df.groupBy(level).agg(F.avg(measure).alias("mean"))
    return row_index(means, ["mean", level], "position")
