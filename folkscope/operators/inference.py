"""Intervals, odds ratios and model comparison for a fitted binomial model."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkscope.operators.models import INTERCEPT, MAX_STEPS, BinomialFit, fit_binomial, moments, terms_frame

# 97.5 percent point of the normal curve, 95 percent point of chi-square with one degree.
Z_95 = 1.959963984540054
CHI2_95 = 3.841458820694124


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution: series below, continued fraction above."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def wald_intervals(spark, fit: BinomialFit) -> DataFrame:
    rows = [
        (name, None, None, None) if np.isnan(b) else (name, float(b), float(b - Z_95 * se), float(b + Z_95 * se))
        for name, b, se in zip(fit.names, fit.coefficients, fit.std_errors)
    ]
    return spark.createDataFrame(rows, "term string, estimate double, lower double, upper double")


def odds_ratios(spark, fit: BinomialFit) -> DataFrame:
    """Odds ratios with their Wald interval."""
    return wald_intervals(spark, fit).select(
        "term", F.exp("estimate").alias("odds_ratio"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper")
    )


def null_model(df: DataFrame, successes: str, failures: str) -> BinomialFit:
    """The intercept-only model, known in closed form from two sums."""
    return fit_binomial(df, successes, failures, [])


def likelihood_ratio(spark, small: BinomialFit, large: BinomialFit) -> DataFrame:
    """Deviance drop between nested fits on the same rows."""
    if small.rows != large.rows:
        raise ValueError("nested fits must use the same rows")
    drop, df = small.deviance - large.deviance, small.residual_df - large.residual_df
    return spark.createDataFrame(
        [(int(df), float(drop), chi_square_tail(drop, df))], "df int, deviance_drop double, p_value double"
    )


def variable_importance(spark, fit: BinomialFit) -> DataFrame:
    """Absolute z statistic per term, largest first, without the intercept."""
    rows = [
        (name, float(abs(b / se)))
        for name, b, se in zip(fit.names, fit.coefficients, fit.std_errors)
        if name != INTERCEPT and not np.isnan(b)
    ]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "term string, importance double")


def profile_interval(df: DataFrame, fit: BinomialFit, term: str) -> DataFrame:
    """Profile-likelihood interval of one coefficient."""
    return profile_intervals(df, fit, [term])


def profile_intervals(df: DataFrame, fit: BinomialFit, terms: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Profile-likelihood intervals of the given, or all, coefficients.

    At an end the deviance has risen by the 95 percent point and the other coefficients
    are at their best. These conditions are solved by Newton steps on all coefficients
    together (Venzon and Moolgavkar, 1988), from the ends that a quadratic likelihood
    would have. All ends of all terms take a step in the same pass over the rows, which
    are persisted for it. An aliased term has null ends; ends that are not reached, as
    where shares drift to 0 or 1, are null.
    """
    wanted = fit.names if terms is None else terms
    places = [fit.names.index(t) for t in wanted if not math.isnan(fit.coefficients[fit.names.index(t)])]
    kept, best = fit.estimated, np.nan_to_num(fit.coefficients)
    searches = [(k, sign) for k in places for sign in (-1, 1)]
    points = [best + s * math.sqrt(CHI2_95) * fit.covariance[:, k] / math.sqrt(fit.covariance[k, k]) for k, s in searches]
    done: list[float | None] = [None] * len(searches)
    rows = terms_frame(df, fit.plan, fit.successes, fit.failures, fit.offset).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        aim = moments(rows, [best])[0][2] - CHI2_95 / 2
        open_ = list(range(len(searches)))
        for _ in range(MAX_STEPS):
            if not open_:
                break
            found = moments(rows, [points[q] for q in open_])
            still = []
            for q, (information, score, likelihood, _) in zip(open_, found):
                k, b = searches[q][0], points[q]
                slot = int(np.flatnonzero(kept == k)[0])
                system = -information[np.ix_(kept, kept)]
                system[slot] = score[kept]
                miss = score[kept].copy()
                miss[slot] = likelihood - aim
                try:
                    step = np.linalg.solve(system, -miss)
                except np.linalg.LinAlgError:
                    continue
                largest = 3 * np.sqrt(np.diag(fit.covariance)[kept])
                step = step * min(1.0, float((largest / np.maximum(np.abs(step), 1e-300)).min()))
                points[q] = b.copy()
                points[q][kept] += step
                if np.all(np.abs(step) <= tolerance * np.sqrt(np.diag(fit.covariance)[kept])):
                    right_side = (points[q][k] - best[k]) * searches[q][1] > 0
                    done[q] = float(points[q][k]) if right_side else None
                else:
                    still.append(q)
            open_ = still
    finally:
        rows.unpersist()
    ends = {k: (done[2 * i], done[2 * i + 1]) for i, k in enumerate(places)}
    out = []
    for t in wanted:
        k = fit.names.index(t)
        out.append((t, float(best[k]) if k in ends else None, *ends.get(k, (None, None))))
    return df.sparkSession.createDataFrame(out, "term string, estimate double, lower double, upper double")
