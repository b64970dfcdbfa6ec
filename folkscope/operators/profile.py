"""Column profiles in long form: one row per column, statistics as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folkscope.operators.quantiles import exact_quantiles

QUARTILES = {0.25: "q25", 0.5: "median", 0.75: "q75"}


def profile_schema(df: DataFrame) -> DataFrame:
    """Position, type and nullability of every column with the number of rows."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    fields = df.sparkSession.createDataFrame(rows, "position int, feature string, type string, nullable boolean")
    return fields.withColumn("rows", df.agg(F.count(F.lit(1))).scalar())


AGGREGATES = 16  # of one pass; the code of many more is too large to be compiled, and runs many times slower


def column_stats(df: DataFrame, columns: list[str], statistics: dict[str, callable]) -> DataFrame:
    """All statistics of all columns, one row per column: a pass over some columns at a time, which reads those alone."""

    def some(part: list[str]) -> DataFrame:
        one_row = df.select(*part).agg(
            *[F.struct(*[fn(c).alias(name) for name, fn in statistics.items()]).alias(c) for c in part]
        )
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in part])
        return one_row.select(F.explode(rows).alias("r")).select("r.feature", "r.s.*")

    width = max(1, AGGREGATES // len(statistics))
    return reduce(DataFrame.unionByName, [some(columns[k : k + width]) for k in range(0, len(columns), width)])


def with_quantiles(stats: DataFrame, df: DataFrame, columns: list[str], names: dict[float, str]) -> DataFrame:
    """Add exact quantiles as columns; both sides have one row per column."""
    quantiles = exact_quantiles(df, columns, list(names))
    wide = quantiles.groupBy("feature").pivot("prob", list(names)).agg(F.max("value"))
    return stats.join(wide.toDF("feature", *names.values()), "feature", "left")


def _nulls(c: str) -> Column:
    return F.count(F.lit(1)) - F.count(c)


def profile_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count."""
    stats = column_stats(
        df,
        columns,
        {
            "min": lambda c: F.min(F.col(c).cast("double")),
            "mean": F.avg,
            "max": lambda c: F.max(F.col(c).cast("double")),
            "n_missing": _nulls,
        },
    )
    return with_quantiles(stats, df, columns, QUARTILES)


def profile_skim(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count, completeness, mean, standard deviation and five quantiles."""
    stats = column_stats(
        df,
        columns,
        {
            "n_missing": _nulls,
            "complete_rate": lambda c: F.count(c) / F.count(F.lit(1)),
            "mean": F.avg,
            "sd": F.stddev_samp,
        },
    )
    return with_quantiles(stats, df, columns, {0.0: "p0", 0.25: "p25", 0.5: "p50", 0.75: "p75", 1.0: "p100"})


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def profile_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count, completeness, shortest and longest, empty and blank texts, distinct values per text column."""
    stats = column_stats(
        df,
        columns,
        {
            "n_missing": _nulls,
            "complete_rate": lambda c: F.count(c) / F.count(F.lit(1)),
            "min_chars": lambda c: F.min(F.char_length(c)),
            "max_chars": lambda c: F.max(F.char_length(c)),
            "empty": lambda c: F.count_if(F.col(c) == ""),
            "blank": lambda c: F.count_if((F.col(c) != "") & (F.trim(c) == "")),
        },
    )
    # Long texts are counted by a digest of fixed size.
    digests = df.select(*[F.sha2(F.col(c), 256).alias(c) for c in columns])
    distinct = value_counts(digests, columns).filter("value IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    return stats.join(distinct, "feature", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, value as text): one pass per column that reads it alone; equal values are counted before
    the shuffle, and only distinct ones become text."""

    def of(c: str) -> DataFrame:
        counted = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return counted.select(F.lit(c).alias("feature"), F.col("value").cast("string").alias("value"), "n")

    return reduce(DataFrame.unionByName, map(of, columns))


def profile_top_values(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """Most frequent values per column with their share, and the number of distinct values.

    The row-number filter cuts every task to ``top`` rows per column before the
    shuffle, so a column of distinct values sends little to its final task.
    """
    counts = value_counts(df.select(*columns), columns).filter("value IS NOT NULL")
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.groupBy("feature").agg(F.sum("n").alias("valid"), F.count(F.lit(1)).alias("n_distinct"))
    return best.join(totals, "feature").select(
        "feature", "rank", "value", "n", (F.col("n") / F.col("valid")).alias("share"), "n_distinct"
    )


def profile_describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, missing, distinct, mean and seven quantiles per column."""
    stats = column_stats(
        df, columns, {"n": lambda c: F.count(c), "missing": _nulls, "mean": F.avg}
    )
    distinct = (
        value_counts(df.select(*columns), columns)
        .filter("value IS NOT NULL")
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("distinct"))
    )
    names = {0.05: "p05", 0.1: "p10", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.9: "p90", 0.95: "p95"}
    return with_quantiles(stats.join(distinct, "feature", "left"), df, columns, names)


def extreme_values(df: DataFrame, columns: list[str], count: int = 5) -> DataFrame:
    """The lowest and highest distinct values per column with their frequencies."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = (
        df.select(F.explode(cells).alias("c"))
        .filter("c.value IS NOT NULL")
        .groupBy("c.feature", "c.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def end(side: str, order: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("feature").orderBy(order))
        ranked = counts.withColumn("rank", rank).filter(F.col("rank") <= count)
        return ranked.select("feature", F.lit(side).alias("side"), "rank", "value", "n")

    return end("lowest", F.asc("value")).unionByName(end("highest", F.desc("value")))


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, variation, percentiles, skewness, kurtosis and ranges."""
    stats = column_stats(
        df,
        columns,
        {
            "mean": F.avg,
            "std_dev": F.stddev_samp,
            "variation_coef": lambda c: F.stddev_samp(c) / F.avg(c),
            "skewness": F.skewness,
            "kurtosis": lambda c: F.kurtosis(c) + 3,
        },
    )
    names = {0.01: "p_01", 0.05: "p_05", 0.25: "p_25", 0.5: "p_50", 0.75: "p_75", 0.95: "p_95", 0.99: "p_99"}
    table = with_quantiles(stats, df, columns, names)
    return table.withColumns(
        {
            "iqr": F.col("p_75") - F.col("p_25"),
            "range_98_lo": F.col("p_01"),
            "range_98_hi": F.col("p_99"),
        }
    )


def normality_test(df: DataFrame, columns: list[str]) -> DataFrame:
    """Jarque-Bera statistic and p-value per column, from moments of one pass."""
    stats = column_stats(
        df, columns, {"n": lambda c: F.count(c), "skewness": F.skewness, "excess": F.kurtosis}
    )
    statistic = F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("excess") ** 2 / 4)
    return stats.select("feature", "n", statistic.alias("statistic"), F.exp(-statistic / 2).alias("p_value"))


KS_PART = "feature int, part int, n long, above double, below double"


def ks_normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of each column to the normal curve with its mean and deviation.

    The jobs do not grow in number with the columns. One aggregate gives moments; then the
    distinct values of all columns, counted with partial aggregation, are range-sorted once by
    column and value. Each task reports, per column, its count and its largest gaps above and
    below, taken with ranks of its own; the values of earlier tasks move all its ranks by one
    amount, so the whole column's gap follows from these few rows. A column that is constant,
    infinite somewhere or without values has no row; NaN counts as missing.
    """
    spark = df.sparkSession
    cells = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    moments = df.agg(*[F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).alias(c) for c, x in cells.items()]).first()
    tested = [c for c in columns if moments[c].sd and math.isfinite(moments[c].sd)]
    schema = "feature string, statistic double, p_value double"
    if not tested:
        return spark.createDataFrame([], schema)
    curves = [(moments[c].n, moments[c].mean, moments[c].sd) for c in tested]

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            features, values, counts = (batch.column(i).to_numpy() for i in range(3))
            for feature in np.unique(features).tolist():
                own = features == feature
                n, mean, sd = curves[feature]
                before, above, below = seen.get(feature, (0, -np.inf, -np.inf))
                up_to = before + np.cumsum(counts[own])
                scaled = (values[own] - mean) / (sd * math.sqrt(2))
                curve = np.array([0.5 * math.erfc(-z) for z in scaled.tolist()])
                above = max(above, float((curve - (up_to - counts[own]) / n).max()))
                below = max(below, float((up_to / n - curve).max()))
                seen[feature] = int(up_to[-1]), above, below
        rows = [(feature, part, *found) for feature, found in seen.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        names = ["feature", "part", "n", "above", "below"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    long = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), cells[c].alias("value")) for i, c in enumerate(tested)]))
    counted = df.select(long.alias("c")).where("c.value IS NOT NULL").groupBy("c.feature", "c.value").agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    parts = ordered.mapInArrow(gaps, KS_PART)
    rank = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum("n").over(rank), F.lit(0)) / F.sum("n").over(Window.partitionBy("feature"))
    largest = parts.select("feature", F.greatest(F.col("above") - moved, F.col("below") + moved).alias("gap"))
    found = largest.groupBy("feature").agg(F.max("gap").alias("statistic")).collect()
    # Only one number per column is left: its p-value comes from the library that Spark's own test asks.
    test = spark.sparkContext._jvm.org.apache.commons.math3.stat.inference.KolmogorovSmirnovTest()
    rows = [(tested[r.feature], r.statistic, 1 - test.cdf(r.statistic, min(curves[r.feature][0], (1 << 31) - 1))) for r in found]
    return spark.createDataFrame(rows, schema)


EDGE = 1e-9

TRANSFORMS = {
    "origin": lambda c: F.col(c).cast("double"),
    "log": lambda c: F.when(F.col(c) > 0, F.ln(F.col(c).cast("double"))),
    "sqrt": lambda c: F.when(F.col(c) >= 0, F.sqrt(F.col(c).cast("double"))),
}


def distribution_bins(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Equal-width histograms of the raw, log and square-root values of every column.

    All ranges are read from one aggregate; the counts are one more pass. A value on an
    edge, up to rounding, is in the bin above.
    """
    forms = [(c, name, fn(c)) for c in columns for name, fn in TRANSFORMS.items()]
    span = df.agg(*[F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(f"s{i}") for i, (_, _, x) in enumerate(forms)]).first()
    cells = []
    for (c, name, x), (lo, hi) in zip(forms, span):
        if lo is None:
            continue
        width = (hi - lo) / bins or 1.0
        # least() passes over nulls, which are in no bin.
        bin_no = F.when(x.isNotNull(), F.least(F.floor((x - lo) / width + EDGE), F.lit(bins - 1)).cast("int") + 1)
        cells.append(F.struct(F.lit(c).alias("feature"), F.lit(name).alias("transform"), bin_no.alias("bin")))
    counted = df.select(F.explode(F.array(*cells)).alias("c")).filter("c.bin IS NOT NULL")
    return counted.groupBy("c.feature", "c.transform", "c.bin").agg(F.count(F.lit(1)).alias("n"))


def normal_quantile_points(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Sample quantiles of every column on a grid against those of the standard normal curve."""
    from statistics import NormalDist

    sample = exact_quantiles(df, columns, probs)
    curve = df.sparkSession.createDataFrame(
        [(float(p), NormalDist().inv_cdf(p)) for p in probs], "prob double, theoretical double"
    )
    return sample.join(curve, "prob").select("feature", "prob", "theoretical", F.col("value").alias("sample"))


def point_pairs(df: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Point sets of several column pairs with the correlation of each pair."""
    points = F.array(
        *[
            F.struct(F.lit(f"{x}~{y}").alias("pair"), F.col(x).alias("x"), F.col(y).alias("y"))
            for x, y in pairs
        ]
    )
    correlations = df.agg(
        F.create_map(*[part for x, y in pairs for part in (F.lit(f"{x}~{y}"), F.corr(x, y))])
    ).scalar()
    rows = df.select(key, F.explode(points).alias("p")).select(key, "p.*")
    return rows.withColumn("correlation", correlations[F.col("pair")])
