"""Profiles by sketches, against exact numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators import sketches
from folkscope.queries.profiles import NUMBERS, _per_column
from folkscope.queries.registry import query
from folkscope.session import materialise
from folkscope.sources.tables import table

PROBS = {"p05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95}


def parts(spark, folder):
    """Sketches of every return flag's rows, stored, as of parts that came one after the other."""
    return materialise(sketches.sketch_columns(table(spark, folder, "lineitem"), NUMBERS, ["l_returnflag"]), "sketches")


@query(
    "sketch_summary",
    _per_column(
        "count(@) AS n, count(*) - count(@) AS n_missing, min($) AS min, round(avg($), 8) AS mean, max($) AS max, true AS distinct_within",
        NUMBERS,
    ),
)
def sketch_summary(spark, folder):
    """Merged sketches: exact columns as they are, the distinct count against the exact one."""
    lines = table(spark, folder, "lineitem")
    found = sketches.sketch_summary(sketches.merge_sketches(parts(spark, folder)), PROBS)
    exact = lines.agg(F.array(*[F.struct(F.lit(c).alias("of"), F.count_distinct(c).alias("exact")) for c in NUMBERS]).alias("x"))
    exact = exact.select(F.explode("x").alias("x")).select("x.*")
    within = F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("distinct_error") * F.col("exact") + 1
    joined = found.join(exact, F.col("feature") == F.col("of"))
    return joined.select("feature", "n", "n_missing", "min", F.round("mean", 8).alias("mean"), "max", within.alias("distinct_within"))


@query(
    "sketch_quantiles",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, true AS within" for c in NUMBERS for p in PROBS.values()),
)
def sketch_quantiles(spark, folder):
    """Whether each merged sketch's quantile has a rank within its bound, by counting all rows."""
    found = sketches.sketch_summary(sketches.merge_sketches(parts(spark, folder)), PROBS)
    return sketches.check_quantiles(table(spark, folder, "lineitem"), found, PROBS).select("feature", "prob", "within")


@query(
    "sketch_groups",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS feature, count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        round(avg({c}), 8) AS mean FROM lineitem GROUP BY 1"""
        for c in NUMBERS
    ),
)
def sketch_groups(spark, folder):
    """The stored sketches by group, without merging."""
    found = sketches.sketch_summary(parts(spark, folder), PROBS)
    return found.select("l_returnflag", "feature", "n", "min", "max", F.round("mean", 8).alias("mean"))
