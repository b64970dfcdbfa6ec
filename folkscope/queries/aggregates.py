"""Grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.functions.numbers import row_sum
from folkscope.operators import aggregates as agg
from folkscope.operators.reshape import heatmap_cells, level_profile, pivot_wide
from folkscope.plans.films import content_summary, country_content, mature_flags, recent_films
from folkscope.queries.analogs import (
    FILMS,
    GENRES,
    MATURE_SQL,
    RATED,
    RATED_COLUMNS,
    SHARES,
    SURVEY,
    TYPES,
    YEAR,
    countries,
    films,
    rated_documents,
    survey,
)
from folkscope.queries.registry import query
from folkscope.sources.tables import table


@query(
    "agg_count_two_keys",
    f"""WITH {FILMS} SELECT production_countries_name, genres_name, count(*) AS n FROM films GROUP BY 1, 2""",
)
def agg_count_two_keys(spark, folder):
    rows = films(spark, folder)
    return rows.groupBy("production_countries_name", "genres_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_weighted_count",
    f"""WITH {SURVEY} SELECT country, answer,
        CASE WHEN count(*) = count(nullif(answer, '5-LOW')) THEN round(sum(weight), 2) END AS weighted_n
    FROM survey GROUP BY country, answer""",
)
def agg_weighted_count(spark, folder):
    """Weights of one answer are blanked to show that a missing weight voids its sum."""
    rows = survey(spark, folder).withColumn("weight", F.when(F.col("answer") != "5-LOW", F.col("weight")))
    counts = agg.weighted_counts(rows, ["country", "answer"])
    return counts.withColumn("weighted_n", F.round("weighted_n", 2))


@query(
    "agg_weighted_share",
    f"""WITH {SHARES} SELECT country, answer, round(weighted_n, 2) AS weighted_n,
        round(weighted_group_size, 2) AS weighted_group_size, round(weighted_estimate, 8) AS weighted_estimate
    FROM shares""",
)
def agg_weighted_share(spark, folder):
    shares = agg.weighted_shares(survey(spark, folder), "country", "answer")
    return shares.select(
        "country",
        "answer",
        F.round("weighted_n", 2).alias("weighted_n"),
        F.round("weighted_group_size", 2).alias("weighted_group_size"),
        F.round("weighted_estimate", 8).alias("weighted_estimate"),
    )


@query(
    "agg_across",
    f"""WITH {FILMS}, flagged AS (SELECT production_countries_name, budget,
        CASE WHEN genres_name IN {MATURE_SQL} OR adult = 'TRUE' THEN 1 ELSE 0 END AS mature FROM films WHERE year > {YEAR})
    SELECT production_countries_name, round(avg(budget), 4) AS budget_mean, round(sum(budget), 2) AS budget_sum,
        round(avg(mature), 8) AS maturecontent_mean, CAST(sum(mature) AS BIGINT) AS maturecontent_sum,
        round(avg(1 - mature), 8) AS notmature_mean, CAST(sum(1 - mature) AS BIGINT) AS notmature_sum
    FROM flagged GROUP BY 1""",
)
def agg_across(spark, folder):
    flagged = mature_flags(recent_films(films(spark, folder), YEAR), GENRES, "as_mature")
    digits = {"budget_mean": 4, "budget_sum": 2, "maturecontent_mean": 8, "notmature_mean": 8}
    summary = content_summary(flagged)
    return summary.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("agg_max", "SELECT c_nationkey, max(c_acctbal) AS c_acctbal FROM customer GROUP BY c_nationkey")
def agg_max(spark, folder):
    return agg.maximum(table(spark, folder, "customer"), ["c_nationkey"], "c_acctbal")


@query(
    "row_sums",
    f"""WITH {RATED} SELECT doc_id, coalesce(quality, 0) + coalesce(toxic, 0) + coalesce(n_chars, 0) AS total
    FROM rated""",
)
def row_sums(spark, folder):
    return rated_documents(spark, folder).select("doc_id", row_sum(["quality", "toxic", "n_chars"]).alias("total"))


@query(
    "majority_response",
    f"""WITH {SHARES} SELECT country, answer, round(weighted_estimate, 8) AS weighted_estimate FROM (
        SELECT *, rank() OVER (PARTITION BY country ORDER BY weighted_estimate DESC) AS r FROM shares) WHERE r = 1""",
)
def majority_response(spark, folder):
    shares = agg.weighted_shares(survey(spark, folder), "country", "answer")
    best = agg.majority(shares, "country", "weighted_estimate")
    return best.select("country", "answer", F.round("weighted_estimate", 8).alias("weighted_estimate"))


@query("freq_table", f"WITH {RATED} SELECT quality, count(*) AS n FROM rated GROUP BY quality")
def freq_table(spark, folder):
    return agg.frequency(rated_documents(spark, folder), "quality")


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, folder):
    return table(spark, folder, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_values", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_values(spark, folder):
    return table(spark, folder, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query(
    "stacked_share",
    f"""WITH {FILMS}, flagged AS (SELECT n_regionkey AS bar, CASE WHEN genres_name IN {MATURE_SQL} THEN 1 ELSE 0 END
        AS maturecontent FROM films JOIN nation ON n_name = production_countries_name),
    counts AS (SELECT bar, maturecontent, count(*) AS n FROM flagged GROUP BY 1, 2)
    SELECT r_name AS income_level, maturecontent, n, round(n / sum(n) OVER (PARTITION BY r_name), 8) AS share
    FROM counts JOIN region ON r_regionkey = bar""",
)
def stacked_share(spark, folder):
    flagged = mature_flags(films(spark, folder), GENRES)
    home = countries(spark, folder).withColumnRenamed("country", "production_countries_name")
    bars = agg.stacked_share(flagged.join(home, "production_countries_name"), "income_level", "maturecontent")
    return bars.withColumn("share", F.round("share", 8))


GENRE_PROFILE = f"""{FILMS}, counts AS (SELECT production_countries_name,
        CASE WHEN vote_count = 7 THEN 'NA' ELSE genres_name END AS genres_name, count(*) AS n
    FROM films WHERE year > {YEAR} GROUP BY 1, 2),
totals AS (SELECT production_countries_name, sum(n) AS total FROM counts GROUP BY 1 HAVING sum(n) > 50),
grid AS (SELECT * FROM totals CROSS JOIN (SELECT DISTINCT genres_name FROM counts)),
perc AS (SELECT production_countries_name, genres_name,
    round_even(100 * coalesce(n, 0) / total, 2) AS perc
    FROM grid LEFT JOIN counts USING (production_countries_name, genres_name))"""


def some_without_genre(spark, folder):
    """Recent films; those with seven votes have no genre, and count in the totals all the same."""
    recent = recent_films(films(spark, folder), YEAR)
    return recent.withColumn("genres_name", F.when(F.col("vote_count") != 7, F.col("genres_name")))


@query(
    "genre_profile",
    f"""WITH {GENRE_PROFILE} SELECT perc.* FROM perc
    WHERE production_countries_name IN (SELECT n_name FROM nation WHERE n_regionkey <> 2) AND genres_name <> 'NA'""",
)
def genre_profile(spark, folder):
    """Heatmap cells of the countries that occur in another table, as the source keeps surveyed countries only."""
    profile = level_profile(some_without_genre(spark, folder), "production_countries_name", "genres_name", [*TYPES, "NA"])
    kept = table(spark, folder, "nation").filter("n_regionkey <> 2")
    return heatmap_cells(
        profile, "production_countries_name", "genres_name", kept.withColumnRenamed("n_name", "production_countries_name")
    )


@query(
    "genre_matrix",
    "WITH " + GENRE_PROFILE + " SELECT production_countries_name, "
    + ", ".join(f"max(CASE WHEN genres_name = '{t}' THEN perc END) AS \"{t}\"" for t in [*TYPES, "NA"])
    + " FROM perc GROUP BY 1",
)
def genre_matrix(spark, folder):
    """The percent grid of every country in wide form; genres are looked up, not given."""
    profile = level_profile(some_without_genre(spark, folder), "production_countries_name", "genres_name")
    return pivot_wide(profile, ["production_countries_name"], "genres_name", "perc", [*TYPES, "NA"])


@query(
    "country_content",
    f"""WITH {FILMS} SELECT production_countries_name, round_even(avg(budget) / 1000, 2) AS budget_mean,
        CAST(sum(CASE WHEN genres_name IN {MATURE_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS maturecontent_sum,
        CAST(sum(CASE WHEN genres_name IN {MATURE_SQL} THEN 0 ELSE 1 END) AS BIGINT) AS notmature_sum
    FROM films WHERE year > {YEAR} AND adult = 'FALSE' GROUP BY 1""",
)
def country_content_query(spark, folder):
    return country_content(films(spark, folder), YEAR, GENRES, "exclude")


@query(
    "missing_profile",
    "WITH " + RATED + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS num_missing, "
        f"round(1 - count({c}) / count(*), 8) AS pct_missing FROM rated"
        for c in RATED_COLUMNS
    ),
)
def missing_profile(spark, folder):
    profile = agg.missing_profile(rated_documents(spark, folder), RATED_COLUMNS)
    return profile.withColumn("pct_missing", F.round("pct_missing", 8))
