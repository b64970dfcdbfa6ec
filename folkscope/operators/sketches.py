"""Profiles by mergeable sketches: one pass over a table, then answers with error bounds from a few kilobytes.

A sketch table has one row per column, and per group where asked for: counts and moments
that are exact, a KLL sketch for ranks and a HyperLogLog sketch for distinct values. Rows
of the same column merge, so a table that grows is sketched part by part, parts are stored,
and any union of them is answered without another look at the rows.

Defined cases: nulls and NaN count as missing; a column without values has null answers;
an empty table has one row per column with counts of 0, or no row where groups are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkscope.operators.quantiles import exact_ranks, numbers, rank_error

RANK_SIZE = 2_048
DISTINCT_BITS = 14
DEVIATIONS = 4  # of the distinct count that its bound allows for
COLUMNS_A_PASS = 4  # the code of many aggregates is too large to be compiled


def distinct_error(bits: int) -> float:
    """Standard error of a HyperLogLog estimate as a share."""
    return 1.04 / 2 ** (bits / 2)


def sketch_columns(df: DataFrame, columns: list[str], by: list[str] | None = None, size: int = RANK_SIZE, bits: int = DISTINCT_BITS) -> DataFrame:
    """(by.., feature, rows, n, total, least, most, ranks, distinct): a sketch of every numeric column, of every group."""
    by = by or []

    def cell(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("feature"),
            F.count(F.lit(1)).alias("rows"),
            F.count(c).alias("n"),
            F.sum(c).alias("total"),
            F.min(c).alias("least"),
            F.max(c).alias("most"),
            F.kll_sketch_agg_double(c, F.lit(size)).alias("ranks"),
            F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias("distinct"),
        )

    def some(part: list[str]) -> DataFrame:
        values = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in part])
        found = (values.groupBy(*by) if by else values).agg(F.array(*map(cell, part)).alias("cells"))
        return found.select(*by, F.explode("cells").alias("s")).select(*by, "s.*")

    return reduce(DataFrame.unionByName, [some(columns[k : k + COLUMNS_A_PASS]) for k in range(0, len(columns), COLUMNS_A_PASS)])


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of the same column, and group where some are kept, as one."""
    return sketches.groupBy(*(by or []), "feature").agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def sketch_summary(sketches: DataFrame, probs: dict[str, float], size: int = RANK_SIZE, bits: int = DISTINCT_BITS) -> DataFrame:
    """Exact counts, mean and range; approximate quantiles by name and distinct count, with their bounds.

    ``rank_error``: a quantile's rank is at most that share of the rows off, with 99
    percent confidence; ``distinct_error``: the count is at most that share off, four deviations.
    """
    asked = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(float(p)))).alias(name) for name, p in probs.items()]
    groups = [c for c in sketches.columns if c not in ("feature", "rows", "n", "total", "least", "most", "ranks", "distinct")]
    return sketches.select(
        *groups,
        "feature",
        "n",
        (F.col("rows") - F.col("n")).alias("n_missing"),
        F.col("least").alias("min"),
        (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"),
        F.col("most").alias("max"),
        *asked,
        F.when(F.col("n") > 0, F.hll_sketch_estimate("distinct")).otherwise(F.lit(0)).alias("n_distinct"),
        F.lit(rank_error(size)).alias("rank_error"),
        F.lit(DEVIATIONS * distinct_error(bits)).alias("distinct_error"),
    )


def check_quantiles(df: DataFrame, summary: DataFrame, probs: dict[str, float]) -> DataFrame:
    """(feature, prob, value, below, upto, within): true ranks of the answers, counted, and whether the bound holds.

    For whoever doubts a sketch: one more pass over the rows. ``summary`` is of whole columns.
    """
    rows = [r for r in summary.collect() if r["n"]]  # one row per column
    answers = [(r["feature"], float(p), float(r[name]), r["n"], r["rank_error"]) for r in rows for name, p in probs.items()]
    given = df.sparkSession.createDataFrame(answers, "feature string, prob double, value double, n long, rank_error double")
    wanted: dict[str, list[float]] = {}
    for feature, _, value, _, _ in answers:
        wanted.setdefault(feature, []).append(value)
    true = exact_ranks(numbers(df, list(wanted)), wanted)
    slack = F.col("rank_error") * F.col("n")
    within = (F.col("below") - slack <= F.col("prob") * F.col("n")) & (F.col("prob") * F.col("n") <= F.col("upto") + slack)
    return given.join(true, ["feature", "value"]).select("feature", "prob", "value", "below", "upto", within.alias("within"))
