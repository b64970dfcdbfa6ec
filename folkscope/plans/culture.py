"""Country tables that bring films, survey answers, country attributes and culture scores together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkscope.fixed_values import MODEL_PREDICTORS, NAME_ALIASES
from folkscope.operators.aggregates import majority
from folkscope.operators.joins import country_chain, join_natural
from folkscope.operators.missing import drop_text_na
from folkscope.operators.models import BinomialFit, fit_binomial
from folkscope.operators.reshape import pivot_wide
from folkscope.operators.survey import collapse_levels, importance_merges, recode
from folkscope.plans.films import model_table
from folkscope.session import materialise


def countries_with_population(countries: DataFrame, population: DataFrame, year: int) -> DataFrame:
    """Country attributes with the population of one year.

    The year is picked before the join; a table with two years would double every country.
    """
    picked = population.filter(F.col("year") == year).drop("year")
    return join_natural(countries, picked, "left")


def harmonised(df: DataFrame, source: str, column: str = "country") -> DataFrame:
    """Country names of one source as the names used everywhere."""
    return recode(df, column, NAME_ALIASES[source])


def wide_answers(shares: DataFrame, answer: str, names: dict[str, str]) -> DataFrame:
    """One row per country with the weighted count of every answer level."""
    return pivot_wide(shares, ["country"], answer, "weighted_n", names)


def collapsed_answers(shares: DataFrame, answer: str, names: dict[str, str], prefix: str) -> DataFrame:
    """Yes, no and neutral counts of an importance question per country."""
    return collapse_levels(wide_answers(shares, answer, names), importance_merges(prefix))


def majority_answers(shares: DataFrame, answer: str, name: str) -> DataFrame:
    best = majority(shares, "country", "weighted_estimate")
    return best.select("country", F.col(answer).alias(name))


def analysis_table(content: DataFrame, countries: DataFrame, answers: DataFrame, scores: DataFrame) -> DataFrame:
    """Model rows, one per country: film totals first, then the chain of dimensions."""
    joined = country_chain(content, countries, answers, scores, "production_countries_name")
    return model_table(joined)


def film_table(films: DataFrame, countries: DataFrame, answers: DataFrame, scores: DataFrame) -> DataFrame:
    """The same chain on single films.

    A few countries hold most films. The derived dimensions are written first, so the
    planner knows how small they are and broadcasts them; the films are not shuffled by
    country at all.
    """
    dimensions = [materialise(d, "dimension") for d in (countries, answers, scores)]
    return country_chain(films, *dimensions, "production_countries_name")


def chart_countries(joined: DataFrame) -> DataFrame:
    """Country and income level as the charts use them: survey names, one row each, no literal NA."""
    named = joined.select(F.col("production_countries_name").alias("country"), "income_level")
    return drop_text_na(harmonised(named, "chart").distinct(), "income_level")


def fit_culture_model(rows: DataFrame, predictors: list[str] = MODEL_PREDICTORS) -> BinomialFit:
    """Mature against other films, explained by income level, attitudes, culture and budget."""
    return fit_binomial(rows, "maturecontent_sum", "notmature_sum", predictors)
