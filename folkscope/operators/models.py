"""Binomial and linear regression.

Rows stay on the executors: each step of a fit is one aggregate over the (persisted)
design rows, and only coefficient vectors and p-by-p matrices reach the driver. A design
row holds its non-zero terms only, so a factor with many levels adds one term to a row and
the sums of products grow with what is there, not with the square of the levels.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import mul

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folkscope.fixed_values import CLASS_THRESHOLD
from folkscope.session import materialise

INTERCEPT = "(Intercept)"
TERMS = "array<struct<i int, x double>>"
ALIAS_TOLERANCE = 1e-9  # what is left of a term's length, as a share, below which it is a sum of earlier ones
MAX_STEPS = 60
MAX_LEVELS = 2_000  # of all text predictors together in a design whose products of terms reach the driver
SEPARATED_LINK = 25.0  # a fitted log-odds beyond this is a share of 0 or 1


def array_literal(values: Sequence) -> Column:
    """Numbers as one constant; a column per number would make a large plan."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


@dataclass(frozen=True)
class Design:
    """Terms of a model: the intercept, numbers, and 0/1 dummies.

    A text predictor gives one dummy per level except the alphabetically first,
    which is the reference level. A missing predictor or an unseen level makes
    the terms of a row null, and with them everything computed from it.
    """

    predictors: list[str]
    levels: dict[str, list[str]]
    numeric: list[str]
    intercept: bool = True

    @property
    def names(self) -> list[str]:
        found = [INTERCEPT] if self.intercept else []
        for p in self.predictors:
            found += [f"{p}_{level}" for level in self.levels[p][1:]] if p in self.levels else [p]
        return found

    def terms(self) -> list[tuple[str, Column]]:
        """Every term as a column of its own."""
        found = [(INTERCEPT, F.lit(1.0))] if self.intercept else []
        for p in self.predictors:
            if p in self.levels:
                known = F.col(p).isin(self.levels[p])
                for level in self.levels[p][1:]:
                    found.append((f"{p}_{level}", F.when(known, (F.col(p) == level).cast("double"))))
            else:
                found.append((p, F.col(p).cast("double")))
        return found

    def row_terms(self) -> Column:
        """The non-zero terms of a row as an array, null where a predictor is missing or a level unseen."""
        parts, at = [], 0
        if self.intercept:
            parts.append(F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("x")))
            at = 1
        complete = F.lit(True)
        for p in self.predictors:
            if p in self.levels:
                # The reference level is place -1, which drops out below.
                places = {level: at + k - 1 if k else -1 for k, level in enumerate(self.levels[p])}
                place = F.element_at(F.from_json(F.lit(json.dumps(places)), "map<string,int>"), F.col(p))
                parts.append(F.struct(place.alias("i"), F.lit(1.0).alias("x")))
                complete = complete & place.isNotNull()
                at += max(0, len(places) - 1)
            else:
                x = F.col(p).cast("double")
                parts.append(F.struct(F.lit(at).alias("i"), x.alias("x")))
                complete = complete & x.isNotNull() & ~F.isnan(x)
                at += 1
        whole = F.array(*parts) if parts else F.from_json(F.lit("[]"), TERMS)
        return F.when(complete, F.filter(whole, lambda t: (t["i"] >= 0) & (t["x"] != 0)))


def dot(terms: Column, coefficients: np.ndarray) -> Column:
    """Sum of terms times coefficients; aliased terms add nothing."""
    b = array_literal(np.nan_to_num(coefficients))
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t["x"] * F.get(b, t["i"]))


def pair_sums(rows: DataFrame, weights: dict[str, Column], cells: dict[str, Column], *by: str) -> list:
    """Sums over all rows: products of non-zero terms times ``weights["pair"]``, terms times ``weights["term"]``, cells.

    Returned as rows (by.., i, j, v): i <= j for pairs, j = -1 for single terms, i = -1 and the
    cell's number in j for cells.
    """
    t = F.col("_terms")

    def with_later(a: Column) -> Column:
        later = F.filter(t, lambda b: b["i"] >= a["i"])
        return F.transform(later, lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (weights["pair"] * a["x"] * b["x"]).alias("v")))

    parts = [F.flatten(F.transform(t, with_later))]
    if "term" in weights:
        parts.append(F.transform(t, lambda a: F.struct(a["i"].alias("i"), F.lit(-1).alias("j"), (weights["term"] * a["x"]).alias("v"))))
    if cells:
        parts.append(F.array(*(F.struct(F.lit(-1).alias("i"), F.lit(k).alias("j"), c.cast("double").alias("v")) for k, c in enumerate(cells.values()))))
    exploded = rows.select(*by, F.explode(F.concat(*parts)).alias("p")).select(*by, "p.i", "p.j", "p.v")
    return exploded.groupBy(*by, "i", "j").agg(F.sum("v").alias("v")).collect()


def independent(gram: np.ndarray) -> np.ndarray:
    """Places of the terms that are no sum of earlier ones, by elimination in the order of the terms."""
    length = np.sqrt(np.maximum(np.diag(gram), 0.0))
    scale = np.where(length > 0, length, 1.0)
    left = gram / np.outer(scale, scale)
    kept = []
    for j in range(len(left)):
        if length[j] > 0 and left[j, j] > ALIAS_TOLERANCE:
            kept.append(j)
            row = left[j].copy()
            left = left - np.outer(row, row) / row[j]
    return np.array(kept, dtype=int)


def design(df: DataFrame, predictors: list[str]) -> Design:
    """Read off the levels of the text predictors; the caller leaves only the rows that are fitted."""
    text = [p for p in predictors if isinstance(df.schema[p].dataType, T.StringType)]
    levels: dict[str, list[str]] = {p: [] for p in text}
    if text:
        pairs = F.array(*[F.struct(F.lit(p).alias("c"), F.col(p).alias("v")) for p in text])
        found = df.dropna(subset=predictors).select(F.explode(pairs).alias("p")).select("p.c", "p.v").distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} levels: factors.fit_factor keeps a factor's levels as a table")
        for row in found:
            levels[row.c].append(row.v)
    return Design(list(predictors), {p: sorted(v) for p, v in levels.items()}, [p for p in predictors if p not in text])


def design_matrix(df: DataFrame, predictors: list[str], keep: list[str], plan: Design | None = None) -> DataFrame:
    """Rows with all predictors present, one column per term."""
    plan = plan or design(df, predictors)
    columns = [col.alias(name) for name, col in plan.terms()]
    return df.dropna(subset=predictors).select(*keep, *columns)


def all_but(df: DataFrame, response: str, *excluded: str) -> list[str]:
    """The predictors of ``response ~ . - excluded``."""
    return [c for c in df.columns if c != response and c not in excluded]


@dataclass(frozen=True)
class BinomialFit:
    """Numbers of a fitted model, and how its counts are read off the rows of the caller's table.

    ``covariance`` is the inverse information matrix; an aliased term, a sum of earlier
    ones, has no estimate (nan) and zeros there. ``separated`` says that some fitted share
    is 0 or 1 as far as numbers go, so that estimates on the way there mean little.
    """

    plan: Design
    successes: Column
    failures: Column
    offset: Column | None
    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    rows: int
    deviance: float
    null_deviance: float | None
    log_likelihood: float
    converged: bool = True
    separated: bool = False
    total_successes: float = field(default=0.0)
    total_trials: float = field(default=0.0)

    @property
    def estimated(self) -> np.ndarray:
        return np.flatnonzero(~np.isnan(self.coefficients))

    @property
    def std_errors(self) -> np.ndarray:
        return np.where(np.isnan(self.coefficients), np.nan, np.sqrt(np.diag(self.covariance)))

    @property
    def residual_df(self) -> int:
        return self.rows - len(self.estimated)

    @property
    def aic(self) -> float:
        return -2.0 * self.log_likelihood + 2.0 * len(self.estimated)

    def link(self) -> Column:
        """Linear predictor with the offset, null where a term is null."""
        link = dot(self.plan.row_terms(), self.coefficients)
        return link if self.offset is None else link + self.offset

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.link()))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by its series after a shift of eight."""
    shift = 8
    y = x + shift
    product = reduce(mul, [x + i for i in range(shift)])
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def _times_log(count: Column, ratio: Column) -> Column:
    """``count * ln(ratio)`` with the limit zero at count zero."""
    return F.when(count > 0, count * F.ln(ratio)).otherwise(0.0)


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms_frame(df: DataFrame, plan: Design, successes: Column, failures: Column, offset: Column | None) -> DataFrame:
    """Successes, trials, non-zero terms and the offset of the rows that are fitted."""
    m, o = successes.cast("double"), failures.cast("double")
    shift = F.lit(0.0) if offset is None else offset.cast("double")
    rows = df.select(m.alias("_m"), (m + o).alias("_n"), plan.row_terms().alias("_terms"), shift.alias("_offset"))
    return rows.dropna().filter("_n > 0")


def moments(rows: DataFrame, points: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """At each of the given coefficients: information, score, log-likelihood without its constant, largest link.

    All points in one pass.
    """
    given = [{"q": q, "b": [float(v) for v in np.nan_to_num(b)]} for q, b in enumerate(points)]
    point = F.explode(F.from_json(F.lit(json.dumps(given)), "array<struct<q int, b array<double>>>"))
    at = rows.withColumn("_point", point).withColumn("_q", F.col("_point.q"))
    link = F.aggregate("_terms", F.lit(0.0), lambda total, t: total + t["x"] * F.get(F.col("_point.b"), t["i"]))
    at = at.withColumn("_link", link + F.col("_offset")).withColumn("_p", 1.0 / (1.0 + F.exp(-F.col("_link"))))
    m, n, p = F.col("_m"), F.col("_n"), F.col("_p")
    # Both logarithms from the link, so that neither is lost where a share is near 0 or 1.
    bend = F.greatest(F.col("_link"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_link")))
    cells = {"likelihood": m * F.col("_link") - n * bend, "far": (F.abs("_link") > SEPARATED_LINK).cast("double")}
    sums = pair_sums(at, {"pair": n * p * (1 - p), "term": m - n * p}, cells, "_q")
    k = len(points[0])
    out = [[np.zeros((k, k)), np.zeros(k), 0.0, 0.0] for _ in points]
    for row in sums:
        found = out[row["_q"]]
        if row.i < 0:
            found[2 + row.j] = row.v
        elif row.j < 0:
            found[1][row.i] = row.v
        else:
            found[0][row.i, row.j] = found[0][row.j, row.i] = row.v
    return [tuple(f) for f in out]


def whole_inverse(information: np.ndarray, kept: np.ndarray) -> np.ndarray:
    inverse = np.zeros_like(information)
    if len(kept):
        part = information[np.ix_(kept, kept)]
        scale = 1 / np.sqrt(np.maximum(np.diag(part), 1e-300))
        inverse[np.ix_(kept, kept)] = np.linalg.pinv(part * np.outer(scale, scale), hermitian=True) * np.outer(scale, scale)
    return inverse


def fit_binomial(
    df: DataFrame,
    successes: str | Column,
    failures: str | Column,
    predictors: list[str],
    offset: str | Column | None = None,
    plan: Design | None = None,
    tolerance: float = 1e-10,
) -> BinomialFit:
    """Binomial regression with logit link on success and failure counts, by Newton steps.

    Counts may be column names or expressions. Levels are read off the rows that are
    fitted. Terms that are sums of earlier ones are left out and reported without an
    estimate. The steps end when the log-likelihood stands still; if it does not within
    ``MAX_STEPS``, as when shares drift to 0 or 1, the fit says ``converged = False``. The
    design rows are persisted for the steps (on disk beyond memory, recomputed when lost).
    """
    successes, failures = as_column(successes), as_column(failures)
    offset = None if offset is None else as_column(offset)
    if plan is None:
        used = df.filter(successes.isNotNull() & failures.isNotNull() & (successes + failures > 0))
        plan = design(used if offset is None else used.filter(offset.isNotNull()), predictors)
    rows = terms_frame(df, plan, successes, failures, offset).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        m, n = F.col("_m"), F.col("_n")
        totals = rows.agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("_m").alias("m"),
            F.sum("_n").alias("n"),
            F.sum(_times_log(m, m / n) + _times_log(n - m, (n - m) / n)).alias("saturated"),
            F.sum(log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1)).alias("choices"),
        ).first()
        if not totals["rows"]:
            raise ValueError("no row has counts and all predictors")
        names = plan.names
        b, converged, far = np.zeros(len(names)), False, 0.0
        share = min(max(totals["m"] / totals["n"], 1e-12), 1 - 1e-12)
        if plan.intercept:
            b[0] = math.log(share / (1 - share))
        information, score, likelihood, far = moments(rows, [b])[0]
        kept = independent(information)
        for _ in range(MAX_STEPS):
            step = whole_inverse(information, kept) @ score
            # A step never moves the link of any term by more than it can come back from.
            step *= min(1.0, 8.0 / max(1e-300, float(np.abs(step).max()) if len(step) else 1.0))
            found = moments(rows, [b + step])[0]
            while not found[2] >= likelihood - 1e-9 * (abs(likelihood) + 1) and np.abs(step).max() > 1e-12:
                step = step / 2
                found = moments(rows, [b + step])[0]
            gain = found[2] - likelihood
            b, (information, score, likelihood, far) = b + step, found
            if abs(gain) > tolerance * (abs(likelihood) + 0.1):
                continue
            if np.abs(step).max(initial=0.0) <= 1e-9 * (1 + np.abs(b).max(initial=0.0)):
                converged = True
                break
            if far:
                break  # drifting without end
        b[np.setdiff1d(np.arange(len(b)), kept)] = np.nan
        null = None
        if offset is None:
            none = _times_log_number(totals["m"], share) + _times_log_number(totals["n"] - totals["m"], 1 - share)
            null = 2 * (totals["saturated"] - none)
        return BinomialFit(
            plan=plan,
            successes=successes,
            failures=failures,
            offset=offset,
            names=names,
            coefficients=b,
            covariance=whole_inverse(information, kept),
            rows=totals["rows"],
            deviance=2 * (totals["saturated"] - likelihood),
            null_deviance=null,
            log_likelihood=totals["choices"] + likelihood,
            converged=converged,
            separated=far > 0,
            total_successes=totals["m"],
            total_trials=totals["n"],
        )
    finally:
        rows.unpersist()


def _times_log_number(count: float, ratio: float) -> float:
    return count * math.log(ratio) if count > 0 else 0.0


def fit_proportion(df: DataFrame, share: str, trials: str, predictors: list[str], offset: str | None = None) -> BinomialFit:
    """The same model given as a proportion with trial weights."""
    m = F.col(share) * F.col(trials)
    return fit_binomial(df, m, (1 - F.col(share)) * F.col(trials), predictors, offset)


def fit_bernoulli(
    df: DataFrame, response: str, predictors: list[str], collapse: bool | None = None, offset: str | None = None
) -> BinomialFit:
    """The same model on 0/1 rows.

    With text predictors only, rows are first counted per combination of levels:
    the counts are sufficient for the fit, so the steps run over a few rows
    instead of the table. Numeric predictors keep their rows unless ``collapse``
    asks otherwise. Deviance and likelihood are those of the single rows, and the fit
    reads its counts off single rows, too.
    """
    y = F.col(response).cast("double")
    also = [] if offset is None else [offset]
    complete = df.dropna(subset=[response, *predictors, *also])
    if collapse is None:
        collapse = not also and all(isinstance(df.schema[p].dataType, T.StringType) for p in predictors)
    if collapse:
        counted = complete.groupBy(*predictors, *also).agg(F.sum(y).alias("_successes"), F.sum(1 - y).alias("_failures"))
        fit = fit_binomial(materialise(counted, "patterns"), "_successes", "_failures", predictors, offset)
    else:
        fit = fit_binomial(complete, y, 1 - y, predictors, offset)
    # For 0/1 rows the saturated likelihood is one, so the deviance is -2 log L of the rows.
    m, n = fit.total_successes, fit.total_trials
    null = -2 * (_times_log_number(m, m / n) + _times_log_number(n - m, 1 - m / n))
    row_deviance = fit.deviance if fit.null_deviance is None else null - (fit.null_deviance - fit.deviance)
    return replace(
        fit,
        successes=y,
        failures=1 - y,
        rows=int(n),
        deviance=row_deviance,
        null_deviance=None if fit.null_deviance is None else null,
        log_likelihood=-row_deviance / 2,
    )


def normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2))


def coefficient_table(spark, fit: BinomialFit) -> DataFrame:
    """Estimate, standard error, z and p per term; null for a term that is a sum of earlier ones."""
    rows = [
        (name, None, None, None, None) if np.isnan(b) else (name, float(b), float(se), float(b / se), normal_tail(b / se))
        for name, b, se in zip(fit.names, fit.coefficients, fit.std_errors)
    ]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, z double, p_value double")


def fit_measures(spark, fit: BinomialFit) -> DataFrame:
    """Deviances with their degrees of freedom and AIC, one row."""
    row = (fit.null_deviance, fit.rows - 1, fit.deviance, fit.residual_df, fit.aic)
    return spark.createDataFrame(
        [row], "null_deviance double, null_df long, residual_deviance double, residual_df long, aic double"
    )


def predict_class(df: DataFrame, fit: BinomialFit, threshold: float = CLASS_THRESHOLD) -> DataFrame:
    """Predicted share and class; rows with a missing predictor stay, with nulls."""
    scored = df.withColumn("probability", fit.probability())
    above = F.col("probability") > threshold
    return scored.withColumn("predicted_class", F.when(above, "pos").when(~above, "neg"))


@dataclass(frozen=True)
class LinearFit:
    plan: Design
    names: list[str]
    table: list[tuple]
    r2: float
    adjusted_r2: float
    sigma: float
    residual_df: int
    f_statistic: float


def fit_linear(df: DataFrame, response: str, predictors: list[str]) -> LinearFit:
    """Ordinary least squares by the normal equations.

    One pass finds the terms that are sums of earlier ones; they stay in the table
    without an estimate. A second pass fits the others.
    """
    complete = df.dropna(subset=[response, *predictors])
    plan = design(complete, predictors)
    names = plan.names
    kept = independent(gram_matrix(complete.select(plan.row_terms().alias("_terms")), len(names)))
    terms = plan.terms()
    columns = [terms[i][1].alias(f"_x{i}") for i in kept if names[i] != INTERCEPT]
    rows = complete.select(F.col(response).cast("double").alias("_y"), *columns)
    features = [f"_x{i}" for i in kept if names[i] != INTERCEPT]
    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    rows = rows.select("_y", "_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        estimator = LinearRegression(featuresCol="_features", labelCol="_y", solver="normal", regParam=0.0)
        model = estimator.fit(rows)
        s = model.summary
        values = [model.intercept, *model.coefficients]
        # Summary arrays carry the intercept last.
        errors = [s.coefficientStandardErrors[-1], *s.coefficientStandardErrors[:-1]]
        t_values = [s.tValues[-1], *s.tValues[:-1]]
        p_values = [s.pValues[-1], *s.pValues[:-1]]
        k, dof = len(features), s.degreesOfFreedom
        found = {
            names[i]: (float(b), float(e), float(t), float(p)) for i, b, e, t, p in zip(kept, values, errors, t_values, p_values)
        }
        table = [(n, *found.get(n, (None,) * 4)) for n in names]
        sigma = math.sqrt(s.meanSquaredError * s.numInstances / dof)
        f_statistic = (s.r2 / k) / ((1 - s.r2) / dof)
        return LinearFit(plan, names, table, s.r2, s.r2adj, sigma, dof, f_statistic)
    finally:
        rows.unpersist()


def gram_matrix(rows: DataFrame, k: int, weight: Column | None = None) -> np.ndarray:
    """Sums of products of all terms over rows with a ``_terms`` array; rows without it are left out."""
    gram = np.zeros((k, k))
    for row in pair_sums(rows.filter("_terms IS NOT NULL"), {"pair": F.lit(1.0) if weight is None else weight}, {}):
        gram[row.i, row.j] = gram[row.j, row.i] = row.v
    return gram


def linear_table(spark, fit: LinearFit) -> DataFrame:
    return spark.createDataFrame(
        fit.table, "term string, estimate double, std_error double, t double, p_value double"
    )


def linear_measures(spark, fit: LinearFit) -> DataFrame:
    """What a summary prints below its table, one row."""
    row = (fit.r2, fit.adjusted_r2, fit.sigma, fit.f_statistic, fit.residual_df)
    return spark.createDataFrame([row], "r2 double, adjusted_r2 double, sigma double, f_statistic double, residual_df long")
