"""Shape of the physical plans: what reaches the scan, what is shuffled, what is not."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folkscope.operators import aggregates, ordering
from folkscope.plans import culture
from folkscope.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize(
    "key",
    ["country_content", "genre_profile", "join_star_chain", "stacked_share", "scale_min_max", "attitude_pairs", "film_table"],
)
def test_no_nested_loops_and_no_python(spark, key):
    plan = plan_of(QUERIES[key](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"):
        assert operator not in plan


@needs_tables
def test_filter_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = plan_of(QUERIES["filter_compare"](spark, FOLDER))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_shipdate,1999-01-01T00:00)" in plan and "GreaterThan(l_quantity,25.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan


def test_group_totals_do_not_shuffle_the_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = plan_of(aggregates.attach_group_total(rows, ["k"], "v", "total"))
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_numbers_inside_levels_do_not_shuffle_the_rows_by_level(spark):
    rows = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")  # under the rows, over the levels
    try:
        numbered = ordering.level_index(rows, "k", ["v"])
        assert "BroadcastHashJoin" in plan_of(numbered) and "Exchange hashpartitioning" not in plan_of(numbered)
        assert numbered.groupBy("k").agg(F.max("index")).count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_films_are_not_shuffled_by_country(spark):
    films = spark.range(1000).select(F.lit("X").alias("production_countries_name"), "id")
    countries = spark.createDataFrame([("X", "High income")], "country string, income_level string")
    answers = spark.createDataFrame([("X", 1.0)], "country string, y double")
    scores = spark.createDataFrame([("X", 50)], "country string, pdi int")
    joined = culture.film_table(films, countries, answers, scores)
    assert "Exchange hashpartitioning" not in plan_of(joined)
    assert joined.count() == 1000


def test_top_n_sorts_no_more_than_n_rows(spark):
    plan = plan_of(ordering.top_n_ties(spark.range(1000).toDF("v"), "v", 3))
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


def test_majority_limits_groups_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("c"), F.col("id").alias("s")).repartition(4)
    assert "WindowGroupLimit" in plan_of(aggregates.majority(rows, "c", "s"))
