"""Sums that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators import exactsums
from folkscope.queries.analogs import SHARES, SURVEY, survey
from folkscope.queries.registry import query
from folkscope.sources.tables import table

UNIT_BITS = 60  # prices of two decimals from 0.01 up are whole numbers of 2**-60


@query(
    "agg_exact_sum",
    f"""SELECT l_suppkey, l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS price_mean,
        CAST(sum(CAST(l_extendedprice * power(2.0, {UNIT_BITS}) AS HUGEINT)) AS VARCHAR) AS price_units
    FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def agg_exact_sum(spark, folder):
    """Exact price totals, to the last bit, as a whole number of units."""
    rows = table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice")
    places = exactsums.digit_places(rows, ["l_extendedprice"])
    states = exactsums.digit_sums(rows, ["l_suppkey", "l_returnflag"], ["l_extendedprice"], places)
    place = places["l_extendedprice"]
    return states.select(
        "l_suppkey",
        "l_returnflag",
        F.col("l_extendedprice.n").alias("n"),
        F.round(exactsums.rounded_sum("l_extendedprice", place, mean=True), 6).alias("price_mean"),
        exactsums.sum_in_units("l_extendedprice", place, UNIT_BITS).alias("price_units"),
    )


@query(
    "agg_exact_total",
    f"""WITH {SURVEY} SELECT country,
        CAST(sum(CAST(weight * power(2.0, {UNIT_BITS}) AS HUGEINT)) AS VARCHAR) AS weight_units FROM survey GROUP BY country""",
)
def agg_exact_total(spark, folder):
    """Country totals merged from the states of their answers."""
    rows = survey(spark, folder)
    places = exactsums.digit_places(rows, ["weight"])
    states = exactsums.digit_sums(rows, ["country", "answer"], ["weight"], places)
    whole = exactsums.merge_digit_sums(states, ["country"], ["weight"], places)
    return whole.select("country", exactsums.sum_in_units("weight", places["weight"], UNIT_BITS).alias("weight_units"))


@query(
    "agg_exact_share",
    f"""WITH {SHARES} SELECT country, answer, round(weighted_n, 2) AS weighted_n,
        round(weighted_group_size, 2) AS weighted_group_size, round(weighted_estimate, 8) AS weighted_estimate
    FROM shares""",
)
def agg_exact_share(spark, folder):
    shares = exactsums.exact_weighted_shares(survey(spark, folder), "country", "answer")
    digits = {"weighted_n": 2, "weighted_group_size": 2, "weighted_estimate": 8}
    return shares.select("country", "answer", *[F.round(c, d).alias(c) for c, d in digits.items()])
