"""Fits against score equations, closed forms and a plain Newton solver."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import RFormula
from pyspark.sql import functions as F

from folkscope.operators import diagnostics, inference, models


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        level = ["High", "Lower", "Upper"][i % 3]
        x, z = float(rng.normal()), float(rng.normal())
        n = int(rng.integers(20, 200))
        p = 1 / (1 + math.exp(-(-0.5 + 0.4 * x - 0.3 * (level == "Upper"))))
        m = int(rng.binomial(n, p))
        rows.append((i, level, x, z, m, n - m))
    rows.append((60, None, 1.0, 1.0, 5, 5))
    rows.append((61, "High", None, 1.0, 5, 5))
    return spark.createDataFrame(rows, "id int, level string, x double, z double, m int, o int").cache()


def newton(X, m, n, offset=0.0):
    b = np.zeros(X.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(X @ b + offset)))
        b = b + np.linalg.solve(X.T @ (X * (n * p * (1 - p))[:, None]), X.T @ (m - n * p))
    p = 1 / (1 + np.exp(-(X @ b + offset)))
    dev = 2 * np.sum(m * np.log(m / (n * p)) + (n - m) * np.log((n - m) / (n * (1 - p))))
    return b, np.linalg.inv(X.T @ (X * (n * p * (1 - p))[:, None])), dev


def arrays(counts):
    rows = [r for r in counts.collect() if r.level is not None and r.x is not None]
    X = np.array([[1.0, r.level == "Lower", r.level == "Upper", r.x, r.z] for r in rows], dtype=float)
    m = np.array([r.m for r in rows], dtype=float)
    return rows, X, m, m + np.array([r.o for r in rows])


PREDICTORS = ["level", "x", "z"]


@pytest.fixture(scope="module")
def fit(counts):
    return models.fit_binomial(counts, "m", "o", PREDICTORS)


def test_fit_matches_newton(counts, fit):
    _, X, m, n = arrays(counts)
    b, cov, dev = newton(X, m, n)
    assert fit.names == ["(Intercept)", "level_Lower", "level_Upper", "x", "z"]
    assert fit.coefficients == pytest.approx(b, abs=1e-8)
    assert fit.covariance == pytest.approx(cov, abs=1e-8)
    assert fit.deviance == pytest.approx(dev, abs=1e-6)
    assert fit.rows == 60 and fit.residual_df == 55
    logs = [math.lgamma(a + 1) - math.lgamma(c + 1) - math.lgamma(a - c + 1) for a, c in zip(n, m)]
    p = 1 / (1 + np.exp(-(X @ b)))
    loglik = sum(logs) + np.sum(m * np.log(p) + (n - m) * np.log(1 - p))
    assert fit.aic == pytest.approx(-2 * loglik + 10, abs=1e-6)


def test_three_forms_agree(spark, counts, fit):
    shares = counts.withColumn("n", F.col("m") + F.col("o")).withColumn("share", F.col("m") / F.col("n"))
    assert models.fit_proportion(shares, "share", "n", PREDICTORS).coefficients == pytest.approx(fit.coefficients, abs=1e-8)
    single = counts.select("level", "x", "z", F.explode(F.expr("array_repeat(1, m) || array_repeat(0, o)")).alias("y"))
    bernoulli = models.fit_bernoulli(single, "y", PREDICTORS)
    assert bernoulli.coefficients == pytest.approx(fit.coefficients, abs=1e-7)
    assert bernoulli.null_deviance - bernoulli.deviance == pytest.approx(fit.null_deviance - fit.deviance, abs=1e-5)
    collapsed = models.fit_bernoulli(single, "y", PREDICTORS, collapse=True)
    assert collapsed.deviance == pytest.approx(bernoulli.deviance, abs=1e-5) and collapsed.rows == bernoulli.rows


def test_design_agrees_with_rformula(spark, counts):
    mine = models.design_matrix(counts, PREDICTORS, ["id"])
    formula = RFormula(formula="m ~ level + x + z", stringIndexerOrderType="alphabetDesc", handleInvalid="skip")
    theirs = {r.id: r.features.toArray() for r in formula.fit(counts).transform(counts).collect()}
    rows = {r.id: tuple(r)[2:] for r in mine.collect()}
    assert set(rows) == set(theirs)
    for key, row in rows.items():
        assert sorted(row) == pytest.approx(sorted(theirs[key]))


def test_a_factor_of_many_levels_against_its_closed_form(spark):
    df = spark.range(2400).selectExpr("CAST(id % 600 AS STRING) AS k", "1 + id % 7 AS m", "2 + id % 5 AS o").cache()
    fit = models.fit_binomial(df, "m", "o", ["k"])
    sums = {r.k: (r.m, r.o) for r in df.groupBy("k").agg(F.sum("m").alias("m"), F.sum("o").alias("o")).collect()}
    first = math.log(sums["0"][0] / sums["0"][1])
    for name, b in zip(fit.names[1:], fit.coefficients[1:]):
        m, o = sums[name.removeprefix("k_")]
        assert b == pytest.approx(math.log(m / o) - first, abs=1e-7)
    assert fit.converged and not fit.separated and len(fit.names) == 600
    hats = diagnostics.augment(df, fit).agg(F.sum("hat")).first()[0]
    assert hats == pytest.approx(600, abs=1e-5)


def test_sums_of_earlier_terms_have_no_estimate(spark, counts, fit):
    twice = counts.withColumn("x2", 2 * F.col("x") + 1)
    again = models.fit_binomial(twice, "m", "o", ["level", "x", "x2", "z"])
    assert again.names[4] == "x2" and math.isnan(again.coefficients[4])
    assert np.delete(again.coefficients, 4) == pytest.approx(fit.coefficients, abs=1e-8)
    assert again.residual_df == fit.residual_df and again.aic == pytest.approx(fit.aic, abs=1e-6)
    table = {r.term: r for r in models.coefficient_table(spark, again).collect()}
    assert table["x2"].estimate is None and table["x"].estimate is not None
    assert {r.term: r.lower for r in inference.wald_intervals(spark, again).collect()}["x2"] is None
    linear = models.fit_linear(twice, "z", ["level", "x", "x2"])
    plain = models.fit_linear(counts, "z", ["level", "x"])
    assert [r[1] for r in linear.table[:-1]] == pytest.approx([r[1] for r in plain.table], abs=1e-9)
    assert linear.table[-1] == ("x2", None, None, None, None)


def test_levels_come_from_the_fitted_rows(spark, counts, fit):
    extra = spark.createDataFrame([(90, "Only here", 0.0, 0.0, None, 3)], counts.schema)
    again = models.fit_binomial(counts.unionByName(extra), "m", "o", PREDICTORS)
    assert again.names == fit.names and again.coefficients == pytest.approx(fit.coefficients, abs=1e-8)


def test_separation_is_flagged(spark):
    rows = [("a", 5, 5), ("a", 4, 6), ("b", 0, 9), ("c", 3, 1)]
    fit = models.fit_binomial(spark.createDataFrame(rows, "k string, m int, o int"), "m", "o", ["k"])
    assert fit.separated and not fit.converged
    assert fit.coefficients[0] == pytest.approx(math.log(9 / 11), abs=1e-6)
    none = models.fit_binomial(spark.createDataFrame([("a", 0, 5)], "k string, m int, o int"), "m", "o", [])
    assert none.separated and none.deviance == pytest.approx(0.0, abs=1e-6)


@pytest.mark.parametrize("shift", [None, "s"])
def test_every_form_carries_diagnostics_and_inference(spark, counts, shift):
    """Augment, refit, profile interval and prediction on counts, proportions and single rows."""
    table = counts.dropna().withColumn("s", F.col("z") / 4).withColumn("n", F.col("m") + F.col("o")).withColumn("share", F.col("m") / F.col("n"))
    single = table.select("id", "level", "x", "s", F.explode(F.expr("array_repeat(1, m) || array_repeat(0, o)")).alias("y"))
    forms = {
        "counts": (table, models.fit_binomial(table, "m", "o", ["level", "x"], shift)),
        "shares": (table, models.fit_proportion(table, "share", "n", ["level", "x"], shift)),
        "single": (single, models.fit_bernoulli(single, "y", ["level", "x"], offset=shift)),
    }
    first = forms["counts"][1]
    rows = table.collect()
    X = np.array([[1.0, r.level == "Lower", r.level == "Upper", r.x] for r in rows], dtype=float)
    link = X @ first.coefficients + (np.array([r.s for r in rows]) if shift else 0.0)
    want = dict(zip([r.id for r in rows], 1 / (1 + np.exp(-link))))
    ends = None
    for df, fit in forms.values():
        assert fit.coefficients == pytest.approx(first.coefficients, abs=1e-7) and fit.converged
        augmented = diagnostics.augment(df, fit)
        assert augmented.agg(F.sum("hat")).first()[0] == pytest.approx(4.0, abs=1e-5)
        assert augmented.agg(F.sum(F.col("resid") ** 2)).first()[0] == pytest.approx(fit.deviance, rel=1e-7)
        for r in models.predict_class(df, fit, 0.3).select("id", "probability").distinct().collect():
            assert r.probability == pytest.approx(want[r.id], abs=1e-8)
        row = inference.profile_interval(df, fit, "x").first()
        ends = ends or (row.lower, row.upper)
        assert (row.lower, row.upper) == pytest.approx(ends, abs=1e-6)
        kept = diagnostics.refit_without(df, table.filter("id < 3"), "id", fit)
        assert kept.rows == df.filter("id >= 3").count()


def test_predictions_pad_missing_rows_and_unseen_levels(spark, counts, fit):
    extra = counts.unionByName(spark.createDataFrame([(99, "Brand new", 0.0, 0.0, 1, 1)], counts.schema))
    scored = {r.id: r for r in models.predict_class(extra, fit, 0.2).collect()}
    assert len(scored) == 63
    assert all(scored[i].probability is None and scored[i].predicted_class is None for i in (60, 61, 99))
    assert sum(1 for r in scored.values() if r.probability is not None) == 60


def test_augment(counts, fit):
    rows, X, m, n = arrays(counts)
    b, cov, _ = newton(X, m, n)
    p = 1 / (1 + np.exp(-(X @ b)))
    h = n * p * (1 - p) * np.einsum("ij,jk,ik->i", X, cov, X)
    out = {r.id: r for r in diagnostics.augment(counts, fit).collect()}
    assert len(out) == 60
    assert sum(r.hat for r in out.values()) == pytest.approx(5.0, abs=1e-6)
    pearson = (m - n * p) / np.sqrt(n * p * (1 - p))
    cook = pearson**2 * h / ((1 - h) ** 2 * 5)
    dev = np.sign(m - n * p) * np.sqrt(2 * (m * np.log(m / (n * p)) + (n - m) * np.log((n - m) / (n * (1 - p)))))
    for i, row in enumerate(rows):
        r = out[row.id]
        assert r.hat == pytest.approx(h[i], abs=1e-8)
        assert r.cooksd == pytest.approx(cook[i], abs=1e-8)
        assert r.std_resid == pytest.approx(dev[i] / math.sqrt(1 - h[i]), abs=1e-6)
        assert r.link_fitted == pytest.approx((X @ b)[i], abs=1e-7)


def test_influence_and_refit(counts, fit):
    augmented = diagnostics.augment(counts, fit)
    top = diagnostics.influential_rows(augmented, 3)
    ids = {r.id for r in top.collect()}
    best = sorted(augmented.collect(), key=lambda r: -r.cooksd)[:3]
    assert ids == {r.id for r in best}
    again = diagnostics.refit_without(counts, top, "id", fit)
    rows, X, m, n = arrays(counts)
    keep = np.array([r.id not in ids for r in rows])
    b, _, _ = newton(X[keep], m[keep], n[keep])
    assert again.rows == 57 and again.coefficients == pytest.approx(b, abs=1e-8)


def test_offset_shifts_the_intercept(counts, fit):
    shifted = models.fit_binomial(counts.withColumn("s", F.lit(0.75)), "m", "o", PREDICTORS, offset="s")
    assert shifted.coefficients[0] == pytest.approx(fit.coefficients[0] - 0.75, abs=1e-7)
    assert shifted.coefficients[1:] == pytest.approx(fit.coefficients[1:], abs=1e-7)
    alone = models.fit_binomial(counts.withColumn("s", F.lit(0.75)), "m", "o", [], offset="s")
    m, o = counts.agg(F.sum("m"), F.sum("o")).first()
    assert alone.coefficients[0] == pytest.approx(math.log(m / o) - 0.75, abs=1e-10)


@pytest.mark.parametrize("term", ["x", "(Intercept)", "level_Upper"])
def test_profile_interval_ends_on_the_deviance_rise(spark, counts, fit, term):
    row = inference.profile_interval(counts, fit, term).first()
    _, X, m, n = arrays(counts)
    slot = fit.names.index(term)
    rest = np.delete(X, slot, axis=1)
    for end in (row.lower, row.upper):
        _, _, dev = newton(rest, m, n, X[:, slot] * end)
        assert dev - fit.deviance == pytest.approx(inference.CHI2_95, abs=1e-4)
    assert row.lower < fit.coefficients[slot] < row.upper


def test_likelihood_ratio_uses_one_set_of_rows(spark, counts, fit):
    small = inference.null_model(counts.dropna(subset=PREDICTORS), "m", "o")
    row = inference.likelihood_ratio(spark, small, fit).first()
    assert row.df == 4 and row.deviance_drop == pytest.approx(fit.null_deviance - fit.deviance, abs=1e-6)
    with pytest.raises(ValueError, match="same rows"):
        inference.likelihood_ratio(spark, inference.null_model(counts, "m", "o"), fit)


def test_tails():
    assert inference.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    for x in (0.5, 3.0, 20.0, 300.0):
        assert inference.chi_square_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-9)
    assert models.normal_tail(inference.Z_95) == pytest.approx(0.05, abs=1e-12)


def test_linear_fit_and_collinearity(spark, counts):
    complete = counts.dropna()
    rows = complete.collect()
    X = np.array([[1.0, r.level == "Lower", r.level == "Upper", r.x] for r in rows], dtype=float)
    y = np.array([r.z for r in rows])
    fitted = models.fit_linear(counts, "z", ["level", "x"])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    residual = y - X @ b
    sigma2 = residual @ residual / (len(y) - 4)
    se = np.sqrt(sigma2 * np.diag(np.linalg.inv(X.T @ X)))
    assert [r[1] for r in fitted.table] == pytest.approx(b, abs=1e-9)
    assert [r[2] for r in fitted.table] == pytest.approx(se, abs=1e-9)
    assert fitted.sigma == pytest.approx(math.sqrt(sigma2), abs=1e-9)

    vif = {r.term: r.vif for r in diagnostics.variance_inflation(counts, ["level", "x", "z"]).collect()}
    Z = np.column_stack([X[:, 1:], y])
    inverse = np.linalg.inv(np.corrcoef(Z, rowvar=False))
    assert list(vif.values()) == pytest.approx(np.diag(inverse), rel=1e-9)

    table = diagnostics.collinearity_table(counts, ["level", "x", "z"]).collect()
    eigen = sorted({round(r.eigenvalue, 9) for r in table}, reverse=True)
    scaled = np.column_stack([np.ones(len(y)), Z])
    scaled = scaled / np.sqrt((scaled**2).sum(axis=0))
    assert eigen == pytest.approx(sorted(np.linalg.eigvalsh(scaled.T @ scaled), reverse=True), abs=1e-8)
    for term in {r.term for r in table}:
        assert sum(r.variance_share for r in table if r.term == term) == pytest.approx(1.0)

    general = {r.predictor: r for r in diagnostics.generalised_inflation(counts, ["level", "x", "z"]).collect()}
    assert general["x"].gvif == pytest.approx(vif["x"], rel=1e-9) and general["level"].df == 2
    R = np.corrcoef(Z, rowvar=False)
    gvif = np.linalg.det(R[:2, :2]) * np.linalg.det(R[2:, 2:]) / np.linalg.det(R)
    assert general["level"].gvif == pytest.approx(gvif, rel=1e-9) and general["level"].scaled == pytest.approx(gvif**0.25, rel=1e-9)


def test_all_but(counts):
    assert models.all_but(counts, "m", "id", "o") == ["level", "x", "z"]


def test_log_gamma(spark):
    xs = [1.0, 1.5, 2.0, 10.0, 1e3, 1e10]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(models.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-10, abs=1e-8)


def test_final_model_has_all_its_terms(spark):
    from folkscope.plans.culture import fit_culture_model

    rng = np.random.default_rng(4)
    rows = [
        (
            ["High income", "Upper middle income", "Lower middle income"][i % 3],
            ["accepted", "not accepted"][int(rng.integers(2))],
            ["Very important", "Not at all important", "Somewhat important"][int(rng.integers(3))],
            *[float(v) for v in rng.normal(size=5)],
            int(rng.integers(20, 80)),
            int(rng.integers(50, 300)),
        )
        for i in range(40)
    ]
    schema = (
        "income_level string, HOMOSEXUALITY string, RELIGION_IMPORT string, extrapolated_genderY double, pdi double, "
        "ltowvs double, ivr double, budget_mean double, maturecontent_sum int, notmature_sum int"
    )
    df = spark.createDataFrame(rows, schema)
    fitted = fit_culture_model(df)
    assert fitted.names[:3] == ["(Intercept)", "income_level_Lower middle income", "income_level_Upper middle income"]
    assert len(fitted.names) == 11
    scored = models.predict_class(df, fitted, 0.2).collect()
    total = sum(r.probability * (r.maturecontent_sum + r.notmature_sum) for r in scored)
    assert total == pytest.approx(sum(r.maturecontent_sum for r in scored), abs=1e-6)
    importance = inference.variable_importance(spark, fitted).collect()
    assert [r.importance for r in importance] == sorted((r.importance for r in importance), reverse=True)


def test_sigma_is_the_left_out_deviation(counts, fit):
    rows = diagnostics.augment(counts, fit).collect()
    total = sum(r.resid**2 for r in rows)
    assert total == pytest.approx(fit.deviance, abs=1e-6)
    for r in rows:
        assert r.sigma == pytest.approx(math.sqrt((total - r.resid**2 / (1 - r.hat)) / (60 - 5 - 1)), abs=1e-8)


def test_profile_intervals_cover_all_terms(counts):
    small = models.fit_binomial(counts, "m", "o", ["x"])
    rows = inference.profile_intervals(counts, small).collect()
    assert [r.term for r in rows] == small.names and all(r.lower < r.estimate < r.upper for r in rows)
