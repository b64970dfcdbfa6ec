"""Frequent values by candidates, without a shuffle of all distinct values.

Every task keeps a Misra-Gries summary of bounded size per column: the counts of its most
frequent values, less what pruning took from all (Agarwal et al., "Mergeable summaries",
2012). Summaries add up. A value's true count is at least its summed count and at most
that plus all that was pruned, so values that could be among the first k are known for
certain; these candidates alone are counted over the rows. Where the pruned sum reaches
the k-th best count, as in a column of nearly distinct values, no candidate set is certain
and the column is counted in full. Nothing is estimated in what is returned.

Defined cases: nulls are left out; ties are ordered by the value as text; a column without
values has no rows; an empty table has none at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folkscope.session import materialise

CAPACITY = 4_096  # values that a task's summary keeps of a column


def prune(held: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    """The most frequent values, all counts less the largest that is dropped; and that count."""
    if held.num_rows <= capacity:
        return held, 0
    n = held["n"].to_numpy()
    dropped = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
    kept = held.filter(pa.array(n > dropped))
    return pa.table({"v": kept["v"], "n": pa.array(kept["n"].to_numpy() - dropped)}), dropped


def summarise(df: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """(value, n, seen, pruned): summed counts of the kept values of all tasks; a null value has the rows seen and the sum pruned."""
    kind = df.schema[column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, pruned, given = None, 0, 0, None
        for batch in batches:
            values = batch.column(0).drop_null()
            given, seen = values.type, seen + len(values)
            counted = values.value_counts()
            part = pa.table({"v": counted.field(0), "n": counted.field(1)})
            held = part if held is None else pa.concat_tables([held, part]).group_by("v").aggregate([("n", "sum")]).rename_columns(["v", "n"])
            if held.num_rows > 4 * capacity:
                held, less = prune(held, capacity)
                pruned += less
        if held is None:
            return
        held, less = prune(held, capacity)
        rows = pa.table({"value": held["v"], "n": held["n"].cast(pa.int64()), "seen": pa.nulls(held.num_rows, pa.int64()), "pruned": pa.nulls(held.num_rows, pa.int64())})
        yield from rows.combine_chunks().to_batches()
        last = [pa.nulls(1, given), pa.array([0], pa.int64()), pa.array([seen], pa.int64()), pa.array([pruned + less], pa.int64())]
        yield pa.RecordBatch.from_arrays(last, names=["value", "n", "seen", "pruned"])

    summaries = df.select(F.col(column).alias("value")).mapInArrow(run, f"value {kind}, n long, seen long, pruned long")
    return summaries.groupBy("value").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("pruned").alias("pruned"))


def frequent_values(df: DataFrame, columns: list[str], top: int = 10, capacity: int = CAPACITY) -> DataFrame:
    """(feature, rank, value, n, share): the ``top`` most frequent values of every column, as text, with exact counts."""

    def summary(c: str) -> DataFrame:
        return summarise(df, c, capacity).select(F.lit(c).alias("feature"), F.col("value").cast("string").alias("value"), "n", "seen", "pruned")

    held = materialise(reduce(DataFrame.unionByName, map(summary, columns)), "summaries")
    best = Window.partitionBy("feature").orderBy(F.desc("n"))
    kth = held.where("value IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    kth = {r["feature"]: (r["n"], r["k"]) for r in kth.groupBy("feature").agg(F.min("n").alias("n"), F.max("rank").alias("k")).collect()}
    totals = {r["feature"]: (r["seen"], r["pruned"]) for r in held.where("value IS NULL").collect()}
    parts = []
    for c, (_, pruned) in totals.items():
        least, found = kth.get(c, (0, 0))
        own = held.where((F.col("feature") == c) & F.col("value").isNotNull())
        text = F.col(c).cast("string")
        if not pruned:  # nothing was dropped, so the sums are the counts
            counted = own.select("value", "n")
        elif found == top and pruned < least:
            candidates = own.where(F.col("n") + pruned >= least).select(F.col("value").alias("candidate"))
            counted = df.select(text.alias("value")).join(candidates, F.col("value") == F.col("candidate"), "left_semi")
            counted = counted.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        else:
            counted = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            counted = counted.select(F.col("value").cast("string").alias("value"), "n")
        parts.append(counted.select(F.lit(c).alias("feature"), "value", "n", F.lit(totals[c][0]).alias("seen")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, rank int, value string, n long, share double")
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("feature", "rank", "value", "n", (F.col("n") / F.col("seen")).alias("share"))
