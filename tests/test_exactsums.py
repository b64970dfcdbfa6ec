"""Order-free sums against exact fractions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from folkscope.operators import exactsums as E


def wild(count, seed=1):
    rng = random.Random(seed)
    values = [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randint(-300, 300)) for _ in range(count)]
    return values + [-v for v in values[: count // 2]] + [5e-324, -5e-324, 1.5e308, -1.5e308, 0.0, -0.0]


@pytest.mark.parametrize("make", [wild, lambda n: [round(random.Random(n).random() * 1e6, 2) for _ in range(n)]])
def test_sums_and_means_are_the_nearest_doubles(spark, make):
    values = make(300)
    rows = [(i % 3, v) for i, v in enumerate(values)]
    out = {r.g: r for r in E.exact_sums(spark.createDataFrame(rows, "g int, x double"), ["g"], ["x"]).collect()}
    for g in range(3):
        own = [Fraction(v) for k, v in rows if k == g]
        total = sum(own)
        assert out[g].x_sum == total.numerator / total.denominator
        mean = total / len(own)
        assert out[g].x_mean == mean.numerator / mean.denominator


def test_same_bits_under_any_partitioning(spark):
    values = [round(random.Random(4).uniform(0.01, 1e5), 2) * (i % 7 + 1) for i in range(5_000)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, x double")
    sums = {E.exact_sums(frame.orderBy(F.rand(s)).repartition(s), [], ["x"]).first().x_sum for s in (1, 3, 8, 17)}
    assert sums == {math.fsum(values)}


def test_merged_states_equal_states_of_all_rows(spark):
    frame = spark.createDataFrame([(i % 2, i % 10, v) for i, v in enumerate(wild(200, 7))], "a int, b int, x double")
    places = E.digit_places(frame, ["x"])
    fine = E.digit_sums(frame, ["a", "b"], ["x"], places)
    one = E.merge_digit_sums(fine, ["a"], ["x"], places).orderBy("a").collect()
    assert one == E.digit_sums(frame, ["a"], ["x"], places).orderBy("a").collect()


def test_nulls_specials_and_empty(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("null", None), ("null", 1.0), ("only", None), ("inf", inf), ("inf", 1.0), ("nan", inf), ("nan", -inf), ("nan2", nan), ("zero", -0.0), (None, 2.5)]
    frame = spark.createDataFrame(rows, "g string, x double")
    strict = {r.g: r.x_sum for r in E.exact_sums(frame, ["g"], ["x"]).collect()}
    loose = {r.g: r.x_sum for r in E.exact_sums(frame, ["g"], ["x"], strict=False).collect()}
    assert strict["null"] is None and loose["null"] == 1.0 and loose["only"] is None
    assert strict["inf"] == inf and math.isnan(strict["nan"]) and math.isnan(strict["nan2"]) and strict["zero"] == 0 and strict[None] == 2.5
    assert E.exact_sums(frame.where("false"), ["g"], ["x"]).count() == 0
    assert E.exact_sums(frame.where("g = 'only'"), [], ["x"], strict=False).first().x_sum is None


def test_overflow_is_infinite(spark):
    frame = spark.createDataFrame([(1.7e308,), (1.7e308,), (1.0,)], "x double")
    assert E.exact_sums(frame, [], ["x"]).first().x_sum == math.inf
    frame = spark.createDataFrame([(1.7e308,), (1.7e308,), (-1.7e308,)], "x double")
    assert E.exact_sums(frame, [], ["x"]).first().x_sum == 1.7e308


def test_rows_are_aggregated_before_python(spark):
    frame = spark.range(100).select((F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("x"))
    plan = E.exact_sums(frame, ["g"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("HashAggregate")


def test_a_missing_weight_voids_answer_and_group(spark):
    frame = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", 1.0), ("b", "y", 3.0), (None, None, 2.0)], "c string, q string, weight double")
    out = {(r.c, r.q): (r.weighted_n, r.weighted_group_size, r.weighted_estimate) for r in E.exact_weighted_shares(frame, "c", "q").collect()}
    assert out == {("a", "x"): (1.0, None, None), ("a", "y"): (None, None, None), ("b", "x"): (1.0, 4.0, 0.25), ("b", "y"): (3.0, 4.0, 0.75), (None, None): (2.0, 2.0, 1.0)}
