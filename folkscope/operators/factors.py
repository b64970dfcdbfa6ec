"""Binomial regression with one factor of any number of levels.

With an intercept per level the information matrix is an arrow: a diagonal over the levels,
a narrow border for the other terms. A Newton step eliminates the diagonal where it is, in
a table of sums per level, and solves only what is left for the other terms, the Schur
complement, on the driver. Estimates, errors and leverages of levels come back by joins.
The driver holds numbers of the other terms alone, whatever the number of levels.

Defined cases: rows with a missing level, predictor, count or offset leave the fit, as do
rows without trials; a level whose trials all succeed, or none, has no finite estimate:
it is reported with an infinite one, and its rows say nothing about the other terms. A
predictor that is constant within levels is a sum of them and is reported without estimate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkscope.operators.models import (
    ALIAS_TOLERANCE,
    INTERCEPT,
    MAX_STEPS,
    Design,
    _times_log,
    _times_log_number,
    array_literal,
    as_column,
    design,
    independent,
    log_gamma,
    normal_tail,
    whole_inverse,
)
from folkscope.session import materialise

MOST_STEP = 8.0  # of a log-odds in one Newton step
MAX_OTHER_TERMS = 60  # each pair of other terms is a sum per level


@dataclass(frozen=True)
class FactorFit:
    """``levels``: level, alpha (its log-odds where all other terms are 0), info, slopes, successes, trials.

    ``slopes`` are the level's weighted means of the other terms, in units of ``centre`` and
    ``spread``, as is ``covariance``; null, with info, for a level without finite estimate.
    """

    factor: str
    plan: Design
    successes: Column
    failures: Column
    offset: Column | None
    levels: DataFrame
    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    rows: int
    level_count: int
    deviance: float
    null_deviance: float | None
    log_likelihood: float
    converged: bool

    @property
    def estimated(self) -> int:
        return self.level_count + int(np.count_nonzero(~np.isnan(self.coefficients)))

    @property
    def residual_df(self) -> int:
        return self.rows - self.estimated

    @property
    def aic(self) -> float:
        return -2.0 * self.log_likelihood + 2.0 * self.estimated


def other_terms(plan: Design) -> Column:
    """The other terms of a row as an array of numbers; null where one is missing."""
    columns = [c.cast("double") for _, c in plan.terms()]
    if not columns:
        return F.array().cast("array<double>")
    complete = columns[0].isNotNull() & ~F.isnan(columns[0])
    for c in columns[1:]:
        complete = complete & c.isNotNull() & ~F.isnan(c)
    return F.when(complete, F.array(*columns))


def scaled(terms: Column, centre: np.ndarray, spread: np.ndarray) -> Column:
    lows, widths = array_literal(centre), array_literal(spread)
    return F.transform(terms, lambda x, j: (x - F.get(lows, j)) / F.get(widths, j))


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def quadratic(a: Column, matrix: np.ndarray) -> Column:
    """a' M a."""
    k, flat = len(matrix), array_literal(matrix.ravel())
    rows = F.transform(a, lambda x, j: x * product(a, F.slice(flat, j * k + 1, F.lit(k))))
    return F.aggregate(rows, F.lit(0.0), lambda total, x: total + x)


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value, to fifteen places, by the all-positive series of the error function."""
    x = F.abs(z) / 2.0**0.5
    start = F.struct(x.alias("term"), x.alias("total"))
    grown = lambda s, k: s["term"] * 2.0 * x * x / (2.0 * k + 1.0)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(160)), start, lambda s, k: F.struct(grown(s, k).alias("term"), (s["total"] + grown(s, k)).alias("total"))
    )
    return F.when(x > 6, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 / np.pi**0.5 * F.exp(-x * x) * series["total"]))


class _Search:
    """Newton steps over written rows (level, m, n, z, offset)."""

    def __init__(self, rows: DataFrame, k: int):
        self.rows, self.k = rows, k
        self.pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(self, levels: DataFrame, beta: np.ndarray) -> DataFrame:
        """Per level, at the given coefficients: information, score, border and the parts of the rest; written."""
        link = F.col("alpha") + product(F.col("z"), array_literal(beta)) + F.col("offset")
        at = self.rows.join(levels, "level").withColumn("link", link).withColumn("p", 1 / (1 + F.exp(-F.col("link"))))
        m, n, p = F.col("m"), F.col("n"), F.col("p")
        bend = F.greatest(F.col("link"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("link")))
        at = at.withColumns({"w": n * p * (1 - p), "r": m - n * p, "likelihood": m * F.col("link") - n * bend})
        z = [F.col("z")[i] for i in range(self.k)]
        return materialise(
            at.groupBy("level").agg(
                F.max("alpha").alias("alpha"),
                F.sum("w").alias("info"),
                F.sum("r").alias("score"),
                F.sum("likelihood").alias("likelihood"),
                *[F.sum(F.col("w") * z[i]).alias(f"b{i}") for i in range(self.k)],
                *[F.sum(F.col("r") * z[i]).alias(f"t{i}") for i in range(self.k)],
                *[F.sum(F.col("w") * z[i] * z[j]).alias(f"c{i}_{j}") for i, j in self.pairs],
            ),
            "levels",
        )

    def rest(self, sums: DataFrame) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Likelihood; Schur complement, its right side, and the diagonal before the levels were eliminated."""
        # A level without information left has none to take away.
        share = F.when(F.col("info") > 0, 1 / F.col("info")).otherwise(0.0)
        found = sums.agg(
            F.sum("likelihood").alias("likelihood"),
            *[F.sum(F.col(f"t{i}") - F.col(f"b{i}") * F.col("score") * share).alias(f"t{i}") for i in range(self.k)],
            *[F.sum(F.col(f"c{i}_{j}") - F.col(f"b{i}") * F.col(f"b{j}") * share).alias(f"s{i}_{j}") for i, j in self.pairs],
            *[F.sum(f"c{i}_{i}").alias(f"c{i}") for i in range(self.k)],
        ).first()
        schur = np.zeros((self.k, self.k))
        for i, j in self.pairs:
            schur[i, j] = schur[j, i] = found[f"s{i}_{j}"] or 0.0
        right, whole = (np.array([found[f"{name}{i}"] or 0.0 for i in range(self.k)]) for name in "tc")
        return found["likelihood"] or 0.0, schur, right, whole

    def moved(self, sums: DataFrame, step: np.ndarray, share: float) -> DataFrame:
        border = F.array(*[F.col(f"b{i}") for i in range(self.k)]).cast("array<double>")
        own = F.when(F.col("info") > 0, (F.col("score") - product(border, array_literal(step))) / F.col("info")).otherwise(0.0)
        own = F.least(F.greatest(own, F.lit(-MOST_STEP)), F.lit(MOST_STEP))
        return sums.select("level", (F.col("alpha") + share * own).alias("alpha"))


def fit_factor(
    df: DataFrame,
    successes: str | Column,
    failures: str | Column,
    factor: str,
    others: list[str] | None = None,
    offset: str | Column | None = None,
    tolerance: float = 1e-10,
) -> FactorFit:
    """``successes/failures ~ factor + others`` with logit link, the factor's levels kept as a table.

    ``others`` are numbers, or text predictors of few levels.
    """
    successes, failures = as_column(successes), as_column(failures)
    offset = None if offset is None else as_column(offset)
    m, o = successes.cast("double"), failures.cast("double")
    complete = df.where(m.isNotNull() & o.isNotNull() & (m + o > 0) & F.col(factor).isNotNull())
    if offset is not None:
        complete = complete.where(offset.isNotNull())
    found = design(complete, list(others or []))
    plan = Design(found.predictors, found.levels, found.numeric, intercept=False)
    k = len(plan.names)
    if k > MAX_OTHER_TERMS:
        raise ValueError(f"{k} terms beside the factor; the factor with most levels should be the one that is kept as a table")
    shift = F.lit(0.0) if offset is None else offset.cast("double")
    raw = complete.select(F.col(factor).alias("level"), m.alias("m"), (m + o).alias("n"), other_terms(plan).alias("x"), shift.alias("offset"))
    raw = raw.where("x IS NOT NULL")
    moments = raw.agg(*[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("a", F.avg), ("s", F.stddev_pop))]).first() if k else {}
    centre = np.array([moments[f"a{i}"] or 0.0 for i in range(k)])
    spread = np.array([moments[f"s{i}"] or 1.0 for i in range(k)])
    rows = materialise(raw.select("level", "m", "n", scaled(F.col("x"), centre, spread).alias("z"), "offset"), "rows")

    counted = materialise(rows.groupBy("level").agg(F.sum("m").alias("successes"), F.sum("n").alias("trials")), "counts")
    finite = (F.col("successes") > 0) & (F.col("successes") < F.col("trials"))
    levels = counted.where(finite).select("level", F.ln(F.col("successes") / (F.col("trials") - F.col("successes"))).alias("alpha"))
    y, n = F.col("m"), F.col("n")
    totals = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("m").alias("m"),
        F.sum("n").alias("n"),
        F.sum(_times_log(y, y / n) + _times_log(n - y, (n - y) / n)).alias("saturated"),
        F.sum(log_gamma(n + 1) - log_gamma(y + 1) - log_gamma(n - y + 1)).alias("choices"),
    ).first()
    if not totals["rows"]:
        raise ValueError("no row has counts, a level and all predictors")

    search, beta = _Search(rows, k), np.zeros(k)
    sums = search.sums(levels, beta)
    likelihood, schur, right, whole = search.rest(sums)
    # What is constant within levels leaves nothing but rounding.
    gone = np.diag(schur) <= ALIAS_TOLERANCE * np.maximum(whole, 1e-300)
    kept = independent(np.where(gone[:, None] | gone[None, :], 0.0, schur))
    # The factor alone has its shares as fitted values, which the search begins from.
    still, converged = 0, not k and offset is None
    for _ in range(0 if converged else MAX_STEPS):
        step, share = whole_inverse(schur, kept) @ right, 1.0
        while True:
            after = search.sums(search.moved(sums, step, share), beta + share * step)
            found = search.rest(after)
            if found[0] >= likelihood - 1e-9 * (abs(likelihood) + 1) or share < 1e-6:
                break
            share /= 2
        gain = found[0] - likelihood
        beta, sums, (likelihood, schur, right, whole) = beta + share * step, after, found
        # Two steps without gain: the first is exact to half the digits, the second to all.
        still = still + 1 if abs(gain) <= tolerance * (abs(likelihood) + 0.1) else 0
        if still == 2:
            converged = True
            break
    slopes = F.array(*[F.col(f"b{i}") / F.col("info") for i in range(k)]).cast("array<double>")
    alpha = F.col("alpha") - float(beta @ (centre / spread))
    fitted = sums.select("level", alpha.alias("alpha"), "info", slopes.alias("slopes"))
    apart = counted.where(~finite).select(F.col("level").alias("of"), F.when(F.col("successes") > 0, float("inf")).otherwise(float("-inf")).alias("end"))
    table = counted.join(fitted, "level", "left").join(apart, F.col("level") == F.col("of"), "left")
    table = materialise(table.select("level", F.coalesce("alpha", "end").alias("alpha"), "info", "slopes", "successes", "trials"), "factor")
    coefficients = beta / spread
    coefficients[np.setdiff1d(np.arange(k), kept)] = np.nan
    null = None
    if offset is None:
        overall = totals["m"] / totals["n"]
        null = 2 * (totals["saturated"] - _times_log_number(totals["m"], overall) - _times_log_number(totals["n"] - totals["m"], 1 - overall))
    return FactorFit(
        factor=factor,
        plan=plan,
        successes=successes,
        failures=failures,
        offset=offset,
        levels=table,
        names=plan.names,
        coefficients=coefficients,
        covariance=whole_inverse(schur, kept),
        centre=centre,
        spread=spread,
        rows=totals["rows"],
        level_count=table.count(),
        deviance=2 * (totals["saturated"] - likelihood),
        null_deviance=null,
        log_likelihood=totals["choices"] + likelihood,
        converged=converged,
    )


def factor_table(fit: FactorFit) -> DataFrame:
    """Estimate, standard error, z and p of every term: levels against the first, as for a factor of few levels."""
    spark = fit.levels.sparkSession
    first = fit.levels.orderBy("level").first()
    shift = fit.centre / fit.spread
    if first["info"] is None:  # every other level is infinitely far from it
        base, ref_slopes, ref_share = first["alpha"], np.zeros(len(fit.names)), float("nan")
    else:
        base, ref_slopes, ref_share = first["alpha"], np.array(first["slopes"], float), 1 / first["info"]
    is_first = F.col("level") == F.lit(first["level"])
    apart = F.zip_with("slopes", array_literal(ref_slopes), lambda a, b: a - b)
    from_zero = F.transform("slopes", lambda a, j: a + F.get(array_literal(shift), j))
    spread = F.when(is_first, 1 / F.col("info") + quadratic(from_zero, fit.covariance))
    spread = spread.otherwise(1 / F.col("info") + F.lit(float(ref_share)) + quadratic(apart, fit.covariance))
    rows = fit.levels.select(
        F.when(is_first, INTERCEPT).otherwise(F.concat(F.lit(f"{fit.factor}_"), F.col("level").cast("string"))).alias("term"),
        F.when(is_first, F.col("alpha")).otherwise(F.col("alpha") - F.lit(float(base))).alias("estimate"),
        F.nanvl(F.sqrt(spread), F.lit(None).cast("double")).alias("std_error"),
    )
    z = F.col("estimate") / F.col("std_error")
    rows = rows.withColumn("z", z).withColumn("p_value", two_sided(F.col("z")))
    errors = np.sqrt(np.diag(fit.covariance)) / fit.spread if len(fit.names) else []
    others = [
        (name, None, None, None, None) if np.isnan(b) else (name, float(b), float(e), float(b / e), normal_tail(b / e))
        for name, b, e in zip(fit.names, fit.coefficients, errors, strict=True)
    ]
    return rows.unionByName(spark.createDataFrame(others, "term string, estimate double, std_error double, z double, p_value double"))


def augment_factor(df: DataFrame, fit: FactorFit) -> DataFrame:
    """Fitted share, leverage, residuals and Cook's distance of every complete row of a known level.

    A row meets its level's numbers by a join; its leverage is its weight times the level's
    share plus the quadratic form of its terms, taken from the level's means.
    """
    m = fit.successes.cast("double")
    n = m + fit.failures.cast("double")
    shift = F.lit(0.0) if fit.offset is None else fit.offset.cast("double")
    known = fit.levels.select(F.col("level").alias("_level"), F.col("alpha").alias("_alpha"), F.col("info").alias("_info"), F.col("slopes").alias("_slopes"))
    rows = df.withColumns({"_x": other_terms(fit.plan), "_n": n, "_shift": shift}).where("_x IS NOT NULL AND _n > 0 AND _shift IS NOT NULL")
    rows = rows.join(known, F.col(fit.factor) == F.col("_level"))
    rows = rows.withColumn("link_fitted", F.col("_alpha") + product(F.col("_x"), array_literal(np.nan_to_num(fit.coefficients))) + F.col("_shift"))
    rows = rows.withColumn("fitted", 1 / (1 + F.exp(-F.col("link_fitted"))))
    p, apart = F.col("fitted"), F.zip_with(scaled(F.col("_x"), fit.centre, fit.spread), "_slopes", lambda a, b: a - b)
    hat = F.col("_n") * p * (1 - p) * (1 / F.col("_info") + quadratic(apart, fit.covariance))
    pearson = F.when(F.col("_info").isNotNull(), (m - n * p) / F.sqrt(n * p * (1 - p)))
    rows = rows.withColumns({"hat": hat, "resid_pearson": pearson})
    free = F.col("hat") < 1 - 1e-9
    cook = F.col("resid_pearson") ** 2 * F.col("hat") / ((1 - F.col("hat")) ** 2 * fit.estimated)
    return rows.withColumn("cooksd", F.when(free, cook)).drop("_x", "_n", "_shift", "_level", "_alpha", "_info", "_slopes")
