"""The arrow-shaped fit against the dense one and against many levels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folkscope.operators import diagnostics, factors, models


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        level, small = f"k{i % 17:02d}", ["a", "b"][i % 2]
        x, z = float(rng.normal(50, 3)), float(rng.normal())
        n = int(rng.integers(1, 30))
        p = 1 / (1 + math.exp(-(-0.5 + 0.1 * (i % 17) / 3 + 0.2 * (x - 50) - 0.3 * (small == "b"))))
        rows.append((i, level, small, x, z, int(rng.binomial(n, p)), n, 0.1 * z))
    rows = [(i, lv, s, x, z, m, n - m, o) for i, lv, s, x, z, m, n, o in rows]
    rows += [(900, None, "a", 1.0, 1.0, 5, 5, 0.0), (901, "k01", "a", None, 1.0, 5, 5, 0.0), (902, "k01", "a", 1.0, 1.0, 0, 0, 0.0)]
    return spark.createDataFrame(rows, "id int, level string, small string, x double, z double, m int, o int, shift double").cache()


def as_dict(frame):
    return {r["term"]: (r["estimate"], r["std_error"], r["z"], r["p_value"]) for r in frame.collect()}


@pytest.mark.parametrize("offset", [None, "shift"])
def test_same_as_the_dense_fit(spark, counts, offset):
    others = ["x", "z", "small"]
    dense = models.fit_binomial(counts, "m", "o", ["level", *others], offset)
    arrow = factors.fit_factor(counts, "m", "o", "level", others, offset)
    want, found = as_dict(models.coefficient_table(spark, dense)), as_dict(factors.factor_table(arrow))
    assert found.keys() == want.keys()
    for term, numbers in want.items():
        assert found[term] == pytest.approx(numbers, rel=1e-6, abs=1e-9), term
    assert arrow.converged and arrow.rows == dense.rows and arrow.residual_df == dense.residual_df
    assert arrow.deviance == pytest.approx(dense.deviance) and arrow.aic == pytest.approx(dense.aic)
    if offset is None:
        assert arrow.null_deviance == pytest.approx(dense.null_deviance)
    columns = ["fitted", "hat", "resid_pearson", "cooksd"]
    a = {r["id"]: [r[c] for c in columns] for r in diagnostics.augment(counts, dense).collect()}
    b = {r["id"]: [r[c] for c in columns] for r in factors.augment_factor(counts, arrow).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert b[i] == pytest.approx(a[i], rel=1e-6, abs=1e-9)


def test_factor_alone_is_closed_form(spark):
    rows = spark.createDataFrame([("a", 3, 5), ("b", 2, 9), ("a", 1, 1), ("c", 4, 4)], "level string, m int, o int")
    fit = factors.fit_factor(rows, "m", "o", "level")
    found = as_dict(factors.factor_table(fit))
    assert found["(Intercept)"][0] == pytest.approx(math.log(4 / 6)) and found["level_c"][0] == pytest.approx(-math.log(4 / 6))
    assert found["level_b"][1] == pytest.approx(math.sqrt(1 / 2 + 1 / 9 + 1 / 4 + 1 / 6))


def test_levels_of_one_outcome_and_constant_predictors(spark):
    rows = [("a", 1, 0, 1.0, 7.0), ("a", 0, 1, 2.0, 7.0), ("a", 1, 0, 2.5, 7.0), ("b", 1, 0, 1.0, 8.0), ("b", 1, 0, 3.0, 8.0), ("c", 0, 1, 1.0, 9.0)]
    rows += [("d", 1, 0, 0.5, 9.0), ("d", 0, 1, 0.7, 9.0), ("d", 0, 1, 0.2, 9.0), ("a", 0, 1, 0.1, 7.0)]
    frame = spark.createDataFrame(rows, "level string, m int, o int, x double, same double")
    fit = factors.fit_factor(frame, "m", "o", "level", ["x", "same"])
    found = as_dict(factors.factor_table(fit))
    assert found["level_b"][0] == math.inf and found["level_c"][0] == -math.inf and found["level_b"][1] is None
    assert found["same"] == (None, None, None, None) and found["x"][0] is not None
    # The other levels are fitted as if those rows were not there.
    rest = models.fit_binomial(frame.where("level IN ('a', 'd')"), "m", "o", ["level", "x"])
    want = as_dict(models.coefficient_table(spark, rest))
    for term in ("(Intercept)", "level_d", "x"):
        assert found[term][:2] == pytest.approx(want[term][:2], rel=1e-6)
    shares = {(r["level"], r["fitted"]) for r in factors.augment_factor(frame, fit).collect() if r["level"] in "bc"}
    assert shares == {("b", 1.0), ("c", 0.0)}
    with pytest.raises(ValueError):
        factors.fit_factor(frame.where("false"), "m", "o", "level")


def test_fifty_thousand_levels_leave_the_driver_alone(spark):
    uniform = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    rows = spark.range(400_000).select((F.col("id") % 50_000).alias("level"), (uniform(1) * 4 - 2).alias("x"), uniform(2).alias("u"))
    rows = rows.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-(F.col("x") * 0.5 + (F.col("level") % 5) * 0.2)))).cast("int"))
    fit = factors.fit_factor(rows, "y", 1 - F.col("y"), "level", ["x"])
    assert fit.converged and fit.level_count == 50_000 and fit.covariance.shape == (1, 1)
    assert factors.factor_table(fit).count() == 50_001
    # The score equations hold, which have one solution: residuals add up to 0 in every level, and so do those times x.
    left = F.col("y") - F.col("fitted")
    sums = factors.augment_factor(rows, fit).groupBy("level").agg(F.sum(left).alias("r"), F.sum(left * F.col("x")).alias("rx"))
    assert sums.where(F.abs("r") > 1e-6).count() == 0 and abs(sums.agg(F.sum("rx")).first()[0]) < 1e-4


def test_p_values(spark):
    frame = spark.createDataFrame([(float(z),) for z in (0, 0.3, -1.96, 3, 5, 7, 12)], "z double")
    for row in frame.select("z", factors.two_sided(F.col("z")).alias("p")).collect():
        assert row["p"] == pytest.approx(models.normal_tail(row["z"]), abs=1e-9)
