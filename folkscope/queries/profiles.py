"""Profiles and exploration."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from folkscope.operators import profile
from folkscope.operators.aggregates import weighted_counts
from folkscope.operators.reshape import pivot_wide
from folkscope.plans.films import country_content, flag_poor_value, flag_profit, share_against_budget
from folkscope.queries.analogs import FILMS, GENRES, MATURE_SQL, PRIORITIES, SURVEY, YEAR, films, rated_documents, survey
from folkscope.queries.registry import query
from folkscope.sources.tables import SCHEMAS, table

NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
QQ_PROBS = [i / 20 for i in range(1, 20)]


def _per_column(select: str, columns: list[str], source: str = "lineitem") -> str:
    """The same one-row SELECT for several columns; ``@`` is the column, ``$`` its DOUBLE form."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, " + select.replace("@", c).replace("$", f"CAST({c} AS DOUBLE)") + f" FROM {source}"
        for c in columns
    )


def _rounded(df, keep: list[str]):
    """Means of two-digit data often end in an exact half at six digits, so they keep eight."""
    return df.select(*[c if c in keep else F.round(c, 8 if c == "mean" else 6).alias(c) for c in df.columns])


def half_normal(z: str) -> str:
    """Area of the normal curve from 0 to abs(z), by the all-positive series of the error function."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))"
    return f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda k: {term}))"


def _quantiles(names: dict[float, str]) -> str:
    return ", ".join(f"round(quantile_cont($, {p}), 6) AS {n}" for p, n in names.items())


@query(
    "profile_schema",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS feature, '{ {'long': 'bigint', 'int': 'int'}.get(t, t) }' AS type, true AS nullable, "
        "(SELECT count(*) FROM lineitem) AS rows"
        for i, (n, t) in enumerate((f.strip().split(" ") for f in SCHEMAS["lineitem"].split(",")), 1)
    ),
)
def profile_schema(spark, folder):
    """The schema as stored in the file, not the declared one."""
    return profile.profile_schema(spark.read.parquet(f"{folder}/lineitem.parquet"))


@query(
    "profile_summary",
    _per_column(
        "round(min($), 6) AS min, round(avg($), 8) AS mean, round(max($), 6) AS max, count(*) - count(@) AS n_missing, "
        + _quantiles(profile.QUARTILES),
        NUMBERS,
    ),
)
def profile_summary(spark, folder):
    return _rounded(profile.profile_summary(table(spark, folder, "lineitem"), NUMBERS), ["feature", "n_missing"])


RATED_NUMBERS = ["doc_id", "n_chars", "quality", "toxic"]


@query(
    "profile_skim",
    _per_column(
        "count(*) - count(@) AS n_missing, round(count(@) / count(*), 6) AS complete_rate, round(avg($), 8) AS mean, "
        "round(stddev_samp($), 6) AS sd, "
        + _quantiles({0.0: "p0", 0.25: "p25", 0.5: "p50", 0.75: "p75", 1.0: "p100"}),
        RATED_NUMBERS,
        "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))",
    ),
)
def profile_skim(spark, folder):
    return _rounded(profile.profile_skim(rated_documents(spark, folder), RATED_NUMBERS), ["feature", "n_missing"])


@query(
    "profile_skim_text",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, round(count({c}) / count(*), 6) AS complete_rate,
        CAST(min(length({c})) AS INTEGER) AS min_chars, CAST(max(length({c})) AS INTEGER) AS max_chars,
        count(*) FILTER ({c} = '') AS empty, count(*) FILTER ({c} <> '' AND trim({c}) = '') AS blank,
        count(DISTINCT {c}) AS n_distinct FROM documents"""
        for c in ("text", "lang", "source")
    ),
)
def profile_skim_text(spark, folder):
    documents = table(spark, folder, "documents")
    return profile.profile_text(documents, profile.text_columns(documents)).withColumn("complete_rate", F.round("complete_rate", 6))


TEXTS = [*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "profile_top_values",
    "WITH counts AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2" for c in TEXTS
    )
    + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank,
        sum(n) OVER (PARTITION BY feature) AS valid, count(*) OVER (PARTITION BY feature) AS n_distinct FROM counts)
    SELECT feature, CAST(rank AS INTEGER) AS rank, value, n, round(n / valid, 8) AS share, n_distinct
    FROM ranked WHERE rank <= 10""",
)
def profile_top_values(spark, folder):
    top = profile.profile_top_values(table(spark, folder, "lineitem"), TEXTS)
    return top.withColumn("share", F.round("share", 8))


DESCRIBED = {0.05: "p05", 0.1: "p10", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.9: "p90", 0.95: "p95"}


@query(
    "profile_describe",
    _per_column(
        "count(@) AS n, count(*) - count(@) AS missing, count(DISTINCT @) AS \"distinct\", round(avg($), 8) AS mean, "
        + _quantiles(DESCRIBED),
        NUMBERS,
    ),
)
def profile_describe(spark, folder):
    described = profile.profile_describe(table(spark, folder, "lineitem"), NUMBERS)
    return _rounded(described, ["feature", "n", "missing", "distinct"])


def _extreme(column: str, side: str, order: str) -> str:
    return f"""SELECT '{column}' AS feature, '{side}' AS side, CAST(rank AS INTEGER) AS rank, value, n FROM (
        SELECT CAST({column} AS DOUBLE) AS value, count(*) AS n, row_number() OVER (ORDER BY CAST({column} AS DOUBLE) {order})
        AS rank FROM lineitem GROUP BY 1) WHERE rank <= 5"""


@query(
    "profile_extremes",
    " UNION ALL ".join(
        _extreme(c, side, order) for c in NUMBERS for side, order in (("lowest", "ASC"), ("highest", "DESC"))
    ),
)
def profile_extremes(spark, folder):
    return profile.extreme_values(table(spark, folder, "lineitem"), NUMBERS)


LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in NUMBERS)


@query(
    "normality_test",
    f"""WITH moments AS (SELECT feature, count(*) AS n, avg(power(v - m, 2)) AS m2, avg(power(v - m, 3)) AS m3,
        avg(power(v - m, 4)) AS m4 FROM (SELECT feature, v, avg(v) OVER (PARTITION BY feature) AS m FROM ({LONG}))
        GROUP BY feature),
    jb AS (SELECT feature, n, n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / power(m2, 2) - 3, 2) / 4) AS s FROM moments)
    SELECT feature, n, round(s, 4) AS statistic, round(exp(-s / 2), 8) AS p_value FROM jb""",
)
def normality_test(spark, folder):
    tested = profile.normality_test(table(spark, folder, "lineitem"), NUMBERS)
    return tested.select("feature", "n", F.round("statistic", 4).alias("statistic"), F.round("p_value", 8).alias("p_value"))


PROFILED = {0.01: "p_01", 0.05: "p_05", 0.25: "p_25", 0.5: "p_50", 0.75: "p_75", 0.95: "p_95", 0.99: "p_99"}


@query(
    "profile_numeric",
    f"""WITH long AS ({LONG}), basic AS (SELECT feature, round(avg(v), 8) AS mean, round(stddev_samp(v), 6) AS std_dev,
        round(stddev_samp(v) / avg(v), 6) AS variation_coef, round(kurtosis_pop(v) + 3, 6) AS kurtosis, """
    + ", ".join(f"round(quantile_cont(v, {p}), 6) AS {n}" for p, n in PROFILED.items())
    + """, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr,
        round(quantile_cont(v, 0.01), 6) AS range_98_lo, round(quantile_cont(v, 0.99), 6) AS range_98_hi
        FROM long GROUP BY feature),
    skew AS (SELECT feature, round(avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5), 6) AS skewness
        FROM (SELECT feature, v, avg(v) OVER (PARTITION BY feature) AS m FROM long) GROUP BY feature)
    SELECT * FROM basic JOIN skew USING (feature)""",
)
def profile_numeric(spark, folder):
    return _rounded(profile.profile_numeric(table(spark, folder, "lineitem"), NUMBERS), ["feature"])


@query(
    "ks_normality",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(max(greatest(cdf - (i - 1) / n, i / n - cdf)), 6) AS statistic FROM (
        SELECT *, 0.5 + sign(z) * {half_normal('z')} AS cdf FROM (
            SELECT i, n, (v - m) / s AS z FROM (SELECT CAST({c} AS DOUBLE) AS v, avg({c}) OVER () AS m,
                stddev_samp({c}) OVER () AS s, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n FROM lineitem)))"""
        for c in NUMBERS
    ),
)
def ks_normality(spark, folder):
    tested = profile.ks_normality(table(spark, folder, "lineitem"), NUMBERS)
    return tested.select("feature", F.round("statistic", 6).alias("statistic"))


def _bins(column: str, name: str, expression: str) -> str:
    expression = expression.replace("@", f"CAST({column} AS DOUBLE)")
    return f"""SELECT '{column}' AS feature, '{name}' AS transform,
        CAST(least(floor((v - lo) / ((hi - lo) / 10) + 1e-9), 9) AS INTEGER) + 1 AS bin,
        count(*) AS n FROM (SELECT {expression} AS v FROM lineitem),
        (SELECT min({expression}) AS lo, max({expression}) AS hi FROM lineitem) WHERE v IS NOT NULL GROUP BY 1, 2, 3"""


@query(
    "distribution_bins",
    " UNION ALL ".join(
        _bins(c, name, e)
        for c in NUMBERS
        for name, e in (
            ("origin", "@"), ("log", "CASE WHEN @ > 0 THEN ln(@) END"), ("sqrt", "CASE WHEN @ >= 0 THEN sqrt(@) END"),
        )
    ),
)
def distribution_bins(spark, folder):
    return profile.distribution_bins(table(spark, folder, "lineitem"), NUMBERS)


@query(
    "qq_points",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS prob, round({NormalDist().inv_cdf(p)!r}::DOUBLE, 8) AS theoretical, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS sample FROM lineitem"
        for c in NUMBERS
        for p in QQ_PROBS
    ),
)
def qq_points(spark, folder):
    points = profile.normal_quantile_points(table(spark, folder, "lineitem"), NUMBERS, QQ_PROBS)
    return points.withColumns({"theoretical": F.round("theoretical", 8), "sample": F.round("sample", 4)})


@query(
    "flag_poor_value",
    f"""WITH {FILMS} SELECT imdb_id, budget, vote_average,
        CASE WHEN budget > 50000 AND vote_average < 5.4 THEN '0' ELSE '1' END AS avg FROM films
    WHERE budget > 0 AND revenue > 0""",
)
def flag_poor_value_query(spark, folder):
    rows = films(spark, folder, country=False, genre=False)
    return flag_poor_value(rows, 50_000, 5.4).select("imdb_id", "budget", "vote_average", "avg")


@query(
    "flag_profit",
    f"""WITH {FILMS} SELECT imdb_id, budget, revenue - budget AS profit,
        CASE WHEN revenue - budget < 0 THEN '0' ELSE '1' END AS profitable FROM films WHERE budget > 0 AND revenue > 0""",
)
def flag_profit_query(spark, folder):
    rows = films(spark, folder, country=False, genre=False)
    return flag_profit(rows).select("imdb_id", "budget", "profit", "profitable")


@query(
    "share_vs_budget",
    f"""WITH {FILMS} SELECT production_countries_name,
        round(avg(CASE WHEN genres_name IN {MATURE_SQL} THEN 1 ELSE 0 END), 8) AS mature_share,
        round_even(avg(budget) / 1000, 2) AS budget_mean FROM films WHERE year > {YEAR} GROUP BY 1""",
)
def share_vs_budget(spark, folder):
    content = country_content(films(spark, folder), YEAR, GENRES)
    return share_against_budget(content).withColumn("mature_share", F.round("mature_share", 8))


@query(
    "attitude_pairs",
    f"""WITH {SURVEY}, wide AS (SELECT country, """
    + ", ".join(f"sum(CASE WHEN answer = '{p}' THEN weight END) AS q_{i}" for i, p in enumerate(PRIORITIES[:3]))
    + " FROM survey GROUP BY country) "
    + " UNION ALL ".join(
        f"SELECT country, '{x}~{y}' AS pair, round({x}, 2) AS x, round({y}, 2) AS y, "
        f"(SELECT round(corr({x}, {y}), 8) FROM wide) AS correlation FROM wide"
        for x, y in (("q_0", "q_1"), ("q_0", "q_2"), ("q_1", "q_2"))
    ),
)
def attitude_pairs(spark, folder):
    names = {p: f"q_{i}" for i, p in enumerate(PRIORITIES[:3])}
    counts = weighted_counts(survey(spark, folder), ["country", "answer"])
    wide = pivot_wide(counts, ["country"], "answer", "weighted_n", names, unlisted="drop")
    points = profile.point_pairs(wide, "country", [("q_0", "q_1"), ("q_0", "q_2"), ("q_1", "q_2")])
    return points.withColumns({"x": F.round("x", 2), "y": F.round("y", 2), "correlation": F.round("correlation", 8)})
