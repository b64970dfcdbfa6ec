import datetime
import math

from pyspark.sql import functions as F

from folkscope.functions import conditions, dates, numbers, text


def values(df):
    return [row[0] for row in df.collect()]


def one(spark, column, value, kind="string"):
    return values(spark.createDataFrame([(value,)], f"x {kind}").select(column))[0]


def test_replace_first_takes_one_match_and_literal_replacement(spark):
    assert one(spark, text.replace_first("x", "a+", "$1\\"), "baab aa") == "b$1\\b aa"
    assert one(spark, text.replace_first("x", "a", "b"), "line\nna") == "line\nnb"
    assert one(spark, text.replace_first("x", "(z)|(q)", "b"), "line") == "line"
    assert one(spark, text.replace_every("x", "a", "b"), "aXa") == "bXb"


def test_labels(spark):
    assert one(spark, text.money_millions("x"), 13_250_000.0, "double") == "$13M"
    assert one(spark, text.money_millions("x"), -2_000_000.0, "double") == "-$2M"
    assert one(spark, text.money_millions("x"), None, "double") is None
    assert one(spark, text.percent_label("x"), 0.2, "double") == "20%"
    assert one(spark, text.join_text("x", F.lit("!")), None) == "NA!"


def test_parse_dmy_formats_and_junk(spark):
    cases = {
        "3/2/2011": datetime.date(2011, 2, 3),
        "03-02-2011": datetime.date(2011, 2, 3),
        "03.02.2011": datetime.date(2011, 2, 3),
        " 31/12/1999 ": datetime.date(1999, 12, 31),
        "3 2 2011": datetime.date(2011, 2, 3),
        "3/2/11": datetime.date(2011, 2, 3),
        "3/2/70": datetime.date(1970, 2, 3),
        "3 Feb 2011": datetime.date(2011, 2, 3),
        "3 February 2011": datetime.date(2011, 2, 3),
        "2011-02-03": None,
        "1/2/3/2011": None,
        "1/2011": None,
        "29/02/2011": None,
        "": None,
        "31/02/2011": None,
        "soon": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert values(df.select(dates.parse_dmy("x"))) == list(cases.values())


def test_released_after_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "dates")
    spark.sql("SELECT DATE'2010-12-31' AS d UNION ALL SELECT DATE'2011-01-01'").write.parquet(path)
    kept = spark.read.parquet(path).filter(dates.released_after("d", 2010))
    assert kept.count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,2011-01-01)" in plan


def test_round_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.675,), (-0.125,)], "x double")
    assert values(df.select(numbers.round_even("x", 2))) == [0.12, 0.38, 2.67 if 2.675 * 100 < 267.5 else 2.68, -0.12]
    assert values(spark.range(1).select(numbers.round_even(F.lit(2.5)))) == [2.0]


def test_fixed_bins_are_closed_on_the_left(spark):
    edges = [0, 20, 40, float("inf")]
    df = spark.createDataFrame([(-1.0,), (0.0,), (19.9,), (20.0,), (40.0,), (1e9,), (None,)], "x double")
    labels = ["[0,20)", "[0,20)", "[20,40)", "[40,Inf)", "[40,Inf)", None]
    assert values(df.select(numbers.fixed_bin("x", edges))) == [None, *labels]


def test_extrapolate_needs_yes_and_no_but_not_neutral(spark):
    df = spark.createDataFrame([(30.0, 60.0, None, 900.0), (30.0, 60.0, 10.0, 900.0), (None, 60.0, 10.0, 900.0)], "y double, n double, u double, p double")
    assert values(df.select(numbers.extrapolate("y", "n", "u", "p"))) == [300.0, 270.0, None]


def test_min_max_scale_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double")
    assert [r.s for r in numbers.min_max_scale(df, "x", "s").collect()] == [0.0, 1.0, 0.5]
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.s for r in numbers.min_max_scale(same, "x", "s").collect()] == [None, None]


def test_number_sequence_has_no_drift(spark):
    ticks = values(numbers.number_sequence(spark, -1.0, 1.0, 0.2))
    assert len(ticks) == 11 and math.isclose(ticks[-1], 1.0, abs_tol=1e-12)


def test_conditions_keep_missing_apart(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert values(df.select(conditions.either(F.col("x") == "a", 1, 0))) == [1, 0, None]
    assert values(df.select(conditions.member_flag("x", ["a"]))) == [1, 0, 0]
    assert values(df.select(conditions.ladder((F.col("x") == "a", 1), (F.col("x") == "c", 2)))) == [1, None, None]
