"""Model diagnostics: per-row influence and collinearity of predictors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkscope.fixed_values import INFLUENTIAL_ROWS, RESIDUAL_BAND
from folkscope.functions.numbers import log_odds
from folkscope.operators.missing import numeric_columns
from folkscope.operators.models import INTERCEPT, BinomialFit, Design, array_literal, design, fit_binomial, gram_matrix
from folkscope.operators.ordering import top_n_ties
from folkscope.session import materialise

# A leverage closer to one than this is one, up to rounding.
FULL_LEVERAGE_GAP = 1e-9


def augment(df: DataFrame, fit: BinomialFit) -> DataFrame:
    """Fitted value, residuals, leverage, left-out deviation and Cook's distance of every complete row.

    Leverage is w x' V x over a row's non-zero terms with the p-by-p covariance V as a
    constant, so each row is computed on its own and the n-by-n hat matrix never exists. A row with leverage
    one fits itself: its standardised residual and distance are undefined, hence null.
    """
    m = fit.successes.cast("double")
    n = m + fit.failures.cast("double")
    k = len(fit.names)
    rows = df.withColumns({"_terms": fit.plan.row_terms(), "_trials": n}).filter("_terms IS NOT NULL AND _trials > 0")
    if fit.offset is not None:
        rows = rows.filter(fit.offset.isNotNull())
    rows = rows.withColumn("link_fitted", fit.link())
    rows = rows.withColumn("fitted", 1.0 / (1.0 + F.exp(-F.col("link_fitted"))))
    p = F.col("fitted")
    spread = array_literal(fit.covariance.ravel())

    def with_all(total, a):
        inner = lambda sub, b: sub + b["x"] * F.get(spread, a["i"] * k + b["i"])
        return total + a["x"] * F.aggregate("_terms", F.lit(0.0), inner)

    quadratic = F.aggregate("_terms", F.lit(0.0), with_all)
    unit = F.when(m > 0, m * F.ln(m / (n * p))).otherwise(0.0)
    unit = unit + F.when(n - m > 0, (n - m) * F.ln((n - m) / (n * (1 - p)))).otherwise(0.0)
    rows = rows.withColumns(
        {
            "hat": n * p * (1 - p) * quadratic,
            "resid": F.signum(m - n * p) * F.sqrt(F.greatest(2 * unit, F.lit(0.0))),
            "resid_pearson": (m - n * p) / F.sqrt(n * p * (1 - p)),
        }
    )
    hat = F.col("hat")
    free = hat < 1 - FULL_LEVERAGE_GAP
    return rows.withColumns(
        {
            "sigma": F.when(free, F.sqrt((fit.deviance - F.col("resid") ** 2 / (1 - hat)) / (fit.residual_df - 1))),
            "std_resid": F.when(free, F.col("resid") / F.sqrt(1 - hat)),
            "cooksd": F.when(free, F.col("resid_pearson") ** 2 * hat / ((1 - hat) * (1 - hat) * len(fit.estimated))),
        }
    ).drop("_terms", "_trials")


def influential_rows(augmented: DataFrame, n: int = INFLUENTIAL_ROWS, digits: int = 8) -> DataFrame:
    """Rows with the largest Cook's distance; rounding makes equal rows tie."""
    return top_n_ties(augmented.withColumn("cooksd", F.round("cooksd", digits)), "cooksd", n)


def residual_band(augmented: DataFrame, limit: float = RESIDUAL_BAND) -> DataFrame:
    return augmented.withColumn("outside", F.abs("std_resid") > limit)


def refit_without(df: DataFrame, removed: DataFrame, key: str, fit: BinomialFit) -> BinomialFit:
    """Fit again after removing rows by key; the keys are written once, not sought again per pass."""
    kept = df.join(materialise(removed.select(key), "removed"), key, "left_anti")
    return fit_binomial(kept, fit.successes, fit.failures, fit.plan.predictors, fit.offset)


def residual_plot_rows(augmented: DataFrame, key: str) -> DataFrame:
    """Coordinates of the four residual plots: residual, scale-location, QQ source and leverage."""
    return augmented.select(
        key,
        "link_fitted",
        "resid",
        "std_resid",
        F.sqrt(F.abs("std_resid")).alias("scale_location"),
        "hat",
        "resid_pearson",
        "cooksd",
    )


def linearity_long(
    df: DataFrame, probability: str, predictors: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Every numeric column beside the log-odds of the fitted share, in long form."""
    predictors = predictors or numeric_columns(df)
    keep = keep or []
    values = [F.col(c).cast("double").alias(c) for c in predictors]
    wide = df.select(*keep, log_odds(probability).alias("logit"), *values)
    return wide.unpivot([*keep, "logit"], predictors, "predictors", "predictor_value")


def correlation_of_terms(rows: DataFrame, plan: Design) -> np.ndarray:
    """Correlations of all terms but the intercept, over complete rows.

    Numbers are taken about their means first; what is left of a 0/1 term's mean is
    subtracted from the sums of products.
    """
    numeric = [F.avg(p).alias(p) for p in plan.numeric]
    means = rows.dropna(subset=plan.predictors).agg(*numeric).first().asDict() if numeric else {}
    centred = rows.withColumns({p: F.col(p).cast("double") - F.lit(float(v or 0.0)) for p, v in means.items()})
    whole = Design(plan.predictors, plan.levels, plan.numeric, intercept=True)
    gram = gram_matrix(centred.select(whole.row_terms().alias("_terms")), len(whole.names))
    mean = gram[0, 1:] / gram[0, 0]
    spread = gram[1:, 1:] / gram[0, 0] - np.outer(mean, mean)
    length = np.sqrt(np.diag(spread))
    return spread / np.outer(length, length)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation matrix as rows ``(x, y, r)``."""
    matrix = correlation_of_terms(df, Design(columns, {}, columns))
    rows = [(x, y, float(matrix[i, j])) for i, x in enumerate(columns) for j, y in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def variance_inflation(df: DataFrame, predictors: list[str], plan: Design | None = None) -> DataFrame:
    """Variance inflation and tolerance per term, from the inverse correlation matrix."""
    plan = plan or design(df, predictors)
    inverse = np.linalg.inv(correlation_of_terms(df, plan))
    names = [n for n in plan.names if n != INTERCEPT]
    rows = [(name, float(1.0 / inverse[i, i]), float(inverse[i, i])) for i, name in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "term string, tolerance double, vif double")


def generalised_inflation(df: DataFrame, predictors: list[str], plan: Design | None = None) -> DataFrame:
    """Generalised variance inflation per predictor, all dummies of a factor together.

    ``gvif`` is det(R11) det(R22) / det(R) over the correlations of the predictor's terms and
    of the others (Fox and Monette, 1992); ``scaled`` is its root of order twice the terms.
    """
    plan = plan or design(df, predictors)
    correlations, at, rows = correlation_of_terms(df, plan), 0, []
    for p in plan.predictors:
        count = len(plan.levels[p]) - 1 if p in plan.levels else 1
        own = np.arange(at, at + count)
        rest = np.setdiff1d(np.arange(len(correlations)), own)
        parts = [np.linalg.slogdet(correlations[np.ix_(i, i)])[1] for i in (own, rest)]
        gvif = float(np.exp(sum(parts) - np.linalg.slogdet(correlations)[1]))
        rows.append((p, count, gvif, gvif ** (1 / (2 * count))))
        at += count
    return df.sparkSession.createDataFrame(rows, "predictor string, df int, gvif double, scaled double")


def collinearity_table(df: DataFrame, predictors: list[str], plan: Design | None = None) -> DataFrame:
    """Eigenvalues, condition indices and variance proportions.

    The cross products of the terms come from one aggregate; columns are scaled to
    unit length, not centred. The p-by-p eigenproblem is solved on the driver.
    """
    plan = plan or design(df, predictors)
    names = plan.names
    k = len(names)
    cross = gram_matrix(df.select(plan.row_terms().alias("_terms")), k)
    length = np.sqrt(np.diag(cross))
    values, vectors = np.linalg.eigh(cross / np.outer(length, length))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    phi = vectors**2 / values
    shares = phi / phi.sum(axis=1, keepdims=True)
    out = [
        (d + 1, float(values[d]), float(np.sqrt(values[0] / values[d])), names[t], float(shares[t, d]))
        for d in range(k)
        for t in range(k)
    ]
    return df.sparkSession.createDataFrame(
        out, "dimension int, eigenvalue double, condition_index double, term string, variance_share double"
    )
