"""Film tables per country and the table the models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkscope.fixed_values import LAST_EXCLUDED_YEAR, MATURE_GENRES, POOR_VALUE_BUDGET, POOR_VALUE_RATING
from folkscope.functions.conditions import member_flag, member_of
from folkscope.functions.dates import parse_dmy
from folkscope.functions.numbers import extrapolate, thousands
from folkscope.operators.aggregates import strict_mean, strict_sum, summarise_across

ADULT_RULES = ("ignore", "exclude", "as_mature")


def recent_films(films: DataFrame, after: int = LAST_EXCLUDED_YEAR) -> DataFrame:
    """Films with a readable release date after the given year; ``year`` is added."""
    dated = films.withColumn("release_date", parse_dmy("release_date"))
    return dated.withColumn("year", F.year("release_date")).filter(F.col("year") > after)


def mature_flags(films: DataFrame, genres: list[str] = MATURE_GENRES, adult: str = "ignore") -> DataFrame:
    """0/1 columns ``maturecontent`` and ``notmature``.

    ``adult`` says what an adult title is: nothing special (``ignore``), left out
    (``exclude``), or mature whatever its genre (``as_mature``).
    """
    if adult not in ADULT_RULES:
        raise ValueError(f"adult must be one of {ADULT_RULES}")
    if adult == "exclude":
        films = films.filter(F.col("adult") == "FALSE")
    flag = member_flag("genres_name", genres)
    if adult == "as_mature":
        flag = F.when(member_of("genres_name", genres) | (F.col("adult") == "TRUE"), 1).otherwise(0)
    flagged = films.withColumn("maturecontent", flag)
    return flagged.withColumn("notmature", 1 - F.col("maturecontent"))


def country_content(
    films: DataFrame,
    after: int = LAST_EXCLUDED_YEAR,
    genres: list[str] = MATURE_GENRES,
    adult: str = "ignore",
) -> DataFrame:
    """Mature count, other count and mean budget in thousands per country.

    Columns are cut to the five used before anything is computed and incomplete
    rows leave, as the source does; the aggregate then has one row per country.
    """
    used = recent_films(films, after).select(
        "production_countries_name", "original_language", "budget", "genres_name", "adult"
    )
    flagged = mature_flags(used.dropna("any"), genres, adult)
    totals = flagged.groupBy("production_countries_name").agg(
        thousands(strict_mean("budget")).alias("budget_mean"),
        F.sum("maturecontent").alias("maturecontent_sum"),
        F.sum("notmature").alias("notmature_sum"),
    )
    return totals


def content_summary(flagged: DataFrame) -> DataFrame:
    """Mean and sum of every measure per country, the wide form before columns are dropped."""
    measures = flagged.select("production_countries_name", "budget", "maturecontent", "notmature")
    return summarise_across(measures, ["production_countries_name"], {"mean": strict_mean, "sum": strict_sum})


def model_table(joined: DataFrame, prefix: str = "gender") -> DataFrame:
    """Model columns: the survey count scaled to the population, on a log scale."""
    scaled = extrapolate(f"{prefix}_Y", f"{prefix}_N", f"{prefix}_Neut", F.col("population").cast("double"))
    used = [f"{prefix}_Y", f"{prefix}_N", f"{prefix}_Neut"]
    return joined.withColumn(f"extrapolated_{prefix}Y", F.ln(scaled)).drop(*used)


def flag_poor_value(films: DataFrame, budget: float = POOR_VALUE_BUDGET, rating: float = POOR_VALUE_RATING) -> DataFrame:
    """Budget against rating: ``0`` marks costly films with a low rating, ``1`` the rest."""
    poor = (F.col("budget") > budget) & (F.col("vote_average") < rating)
    flagged = films.withColumn("avg", F.when(poor, "0").when(~poor, "1"))
    return flagged.filter((F.col("budget") > 0) & (F.col("revenue") > 0))


def flag_profit(films: DataFrame) -> DataFrame:
    """Profit and whether there is one, for films with both sums known."""
    profit = films.withColumn("profit", F.col("revenue") - F.col("budget"))
    loss = F.col("profit") < 0
    flagged = profit.withColumn("profitable", F.when(loss, "0").when(~loss, "1"))
    return flagged.filter((F.col("budget") > 0) & (F.col("revenue") > 0))


def share_against_budget(content: DataFrame) -> DataFrame:
    """Mature share of each country beside its mean budget."""
    total = F.col("maturecontent_sum") + F.col("notmature_sum")
    return content.select(
        "production_countries_name", (F.col("maturecontent_sum") / total).alias("mature_share"), "budget_mean"
    )
