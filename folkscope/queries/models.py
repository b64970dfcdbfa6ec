"""Models, diagnostics and inference.

The fitted rows are suppliers with their counts of mature and other order lines. With the
region as only factor the model has one free probability per region, so every number has a
closed form that the SQL computes from the counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.fixed_values import INFLUENTIAL_ROWS, RESIDUAL_BAND
from folkscope.operators import diagnostics, factors, inference, models
from folkscope.plans import culture
from folkscope.plans.films import country_content
from folkscope.queries.analogs import GENRES, MATURE_SQL, YEAR, countries, films, scores
from folkscope.queries.joins import FULL, answers, population
from folkscope.queries.registry import query
from folkscope.session import materialise
from folkscope.sources.tables import table

COUNTS = ("maturecontent_sum", "notmature_sum")


def at_home(rows, spark, folder):
    """Supplier, country and income level beside ``l_suppkey``, one stored table after another."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    joined = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(*rows.columns, "s_suppkey", "s_acctbal", "n_name", F.col("r_name").alias("income_level"))


def content(spark, folder):
    """Suppliers with their content counts; order lines are counted before suppliers join.

    The counts are written once: levels, iterations and diagnostics read the small table
    and never go back to the order lines.
    """
    part = table(spark, folder, "part").select("p_partkey", F.col("p_type").isin(GENRES).cast("int").alias("mature"))
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    counted = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey")
        .agg(
            F.sum("mature").alias("maturecontent_sum"),
            F.sum(1 - F.col("mature")).alias("notmature_sum"),
            (F.avg("l_extendedprice") / 1000).alias("budget_mean"),
        )
    )
    return materialise(at_home(counted, spark, folder).drop("l_suppkey"), "content")


CONTENT = f"""content AS (
  SELECT s_suppkey, s_acctbal, n_name, r_name AS income_level, m, o, m + o AS n, budget_mean FROM (
    SELECT l_suppkey, CAST(sum(CASE WHEN p_type IN {MATURE_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS m,
           CAST(sum(CASE WHEN p_type IN {MATURE_SQL} THEN 0 ELSE 1 END) AS BIGINT) AS o,
           avg(l_extendedprice) / 1000 AS budget_mean
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def closed_form(source: str = "content") -> str:
    """``grp``: counts per region; ``coef``: estimates and errors; ``rws``: rows with their fitted share."""
    return f"""grp AS (SELECT income_level, CAST(sum(m) AS DOUBLE) AS gm, CAST(sum(o) AS DOUBLE) AS go,
    CAST(sum(n) AS DOUBLE) AS gn FROM {source} GROUP BY 1),
ref AS (SELECT income_level AS ref_level, gm AS rm, go AS ro, gn AS rn FROM grp
    WHERE income_level = (SELECT min(income_level) FROM grp)),
coef AS (SELECT '(Intercept)' AS term, ln(rm / ro) AS b, sqrt(1 / rm + 1 / ro) AS se FROM ref
    UNION ALL SELECT 'income_level_' || income_level, ln(gm / go) - ln(rm / ro), sqrt(1 / gm + 1 / go + 1 / rm + 1 / ro)
    FROM grp, ref WHERE income_level <> ref_level),
rws AS (SELECT *, gm / gn AS p, n / gn AS h FROM {source} JOIN grp USING (income_level))"""


BASE = f"WITH {CONTENT}, {closed_form()}"

DIAG = f"""{BASE}, unit AS (SELECT *, ln(p / (1 - p)) AS link_fitted, (m - n * p) / sqrt(n * p * (1 - p)) AS pearson,
    2 * (CASE WHEN m > 0 THEN m * ln(m / (n * p)) ELSE 0 END + CASE WHEN o > 0 THEN o * ln(o / (n * (1 - p))) ELSE 0 END)
    AS d FROM rws),
aug AS (SELECT *, sign(m - n * p) * sqrt(greatest(d, 0)) AS resid,
    CASE WHEN h < 1 THEN sign(m - n * p) * sqrt(greatest(d, 0) / (1 - h)) END AS std_resid,
    CASE WHEN h < 1 THEN pearson * pearson * h / ((1 - h) * (1 - h) * (SELECT count(*) FROM grp)) END AS cooksd FROM unit)"""


def normal_p(z: str) -> str:
    """Two-sided normal p-value by the all-positive series of the error function."""
    x = f"(abs({z}) / sqrt(2))"
    term = f"exp(2 * k * ln(2) + (2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(2 * k + 2) + lgamma(k + 1))"
    return (
        f"CASE WHEN abs({z}) > 8 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * "
        f"list_sum(list_transform(range(0, 250), lambda k: {term})) END"
    )


def student_p(t: str, df: str) -> str:
    """Two-sided p-value of Student's t by Simpson's rule over its density."""
    height = f"pow(1 + pow(k * abs({t}) / 4000.0, 2) / {df}, -({df} + 1) / 2.0)"
    weight = "CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, 4001), lambda k: {weight} * {height})) * abs({t}) / 12000.0"
    return f"1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * {area}"


def fit(spark, folder):
    rows = content(spark, folder)
    return rows, models.fit_binomial(rows, *COUNTS, ["income_level"])


def _rounded(df, digits: dict[str, int]):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


NUMERIC_FORM = f"""WITH {CONTENT}, two AS (SELECT CASE WHEN income_level IN ('ASIA', 'EUROPE') THEN 1 ELSE 0 END AS x,
    CAST(sum(m) AS DOUBLE) AS m, CAST(sum(o) AS DOUBLE) AS o FROM content GROUP BY 1),
c AS (SELECT a.m AS am, a.o AS ao, b.m AS bm, b.o AS bo FROM two a, two b WHERE a.x = 0 AND b.x = 1)
SELECT '(Intercept)' AS term, round(ln(am / ao), 6) AS estimate, round(sqrt(1 / am + 1 / ao), 6) AS std_error FROM c
UNION ALL SELECT 'rich', round(ln(bm / bo) - ln(am / ao), 6), round(sqrt(1 / am + 1 / ao + 1 / bm + 1 / bo), 6) FROM c"""


@query("glm_proportion", NUMERIC_FORM)
def glm_proportion(spark, folder):
    total = F.col("maturecontent_sum") + F.col("notmature_sum")
    rows = content(spark, folder).select(
        (F.col("maturecontent_sum") / total).alias("share"),
        total.alias("trials"),
        F.col("income_level").isin("ASIA", "EUROPE").cast("int").alias("rich"),
    )
    fitted = models.fit_proportion(rows, "share", "trials", ["rich"])
    table_ = models.coefficient_table(spark, fitted).select("term", "estimate", "std_error")
    return _rounded(table_, {"estimate": 6, "std_error": 6})


@query("glm_counts", f"{BASE} SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error FROM coef")
def glm_counts(spark, folder):
    _, fitted = fit(spark, folder)
    table_ = models.coefficient_table(spark, fitted).select("term", "estimate", "std_error")
    return _rounded(table_, {"estimate": 6, "std_error": 6})


def newton(names: tuple[str, str]) -> str:
    """Twenty Newton steps for an intercept and two numbers, on rows ``v(m, n, x1, x2)``."""
    return f"""it AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2,
        1.0::DOUBLE AS v0, 1.0::DOUBLE AS v1, 1.0::DOUBLE AS v2
    UNION ALL
    SELECT k + 1, b0 + c00 * s0 + c01 * s1 + c02 * s2, b1 + c01 * s0 + c11 * s1 + c12 * s2,
        b2 + c02 * s0 + c12 * s1 + c22 * s2, c00, c11, c22
    FROM (SELECT *, (d * f - e * e) / det AS c00, (c * e - b * f) / det AS c01, (b * e - c * d) / det AS c02,
            (a * f - c * c) / det AS c11, (b * c - a * e) / det AS c12, (a * d - b * b) / det AS c22
        FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det
            FROM (SELECT k, b0, b1, b2, sum(r) AS s0, sum(r * x1) AS s1, sum(r * x2) AS s2, sum(w) AS a, sum(w * x1) AS b,
                    sum(w * x2) AS c, sum(w * x1 * x1) AS d, sum(w * x1 * x2) AS e, sum(w * x2 * x2) AS f
                FROM (SELECT *, m - n * p AS r, n * p * (1 - p) AS w
                    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM it, v WHERE k < 20))
                GROUP BY k, b0, b1, b2))))
    SELECT '(Intercept)' AS term, round(b0, 5) AS estimate, round(sqrt(v0), 5) AS std_error FROM it WHERE k = 20
    UNION ALL SELECT '{names[0]}', round(b1, 5), round(sqrt(v1), 5) FROM it WHERE k = 20
    UNION ALL SELECT '{names[1]}', round(b2, 5), round(sqrt(v2), 5) FROM it WHERE k = 20"""


@query(
    "glm_numeric",
    f"""WITH RECURSIVE {CONTENT}, v AS MATERIALIZED (SELECT CAST(m AS DOUBLE) AS m, CAST(n AS DOUBLE) AS n,
        budget_mean / 10 AS x1, s_acctbal / 1000 AS x2 FROM content), {newton(('budget', 'balance'))}""",
)
def glm_numeric(spark, folder):
    """Two numeric predictors, where no closed form exists: the SQL iterates."""
    rows = content(spark, folder).select(
        *COUNTS, (F.col("budget_mean") / 10).alias("budget"), (F.col("s_acctbal") / 1000).alias("balance")
    )
    fitted = models.fit_binomial(rows, *COUNTS, ["budget", "balance"])
    table_ = models.coefficient_table(spark, fitted).select("term", "estimate", "std_error")
    return _rounded(table_, {"estimate": 5, "std_error": 5})


def ascent(terms: dict[str, str], steps: int = 4000) -> str:
    """Newton steps for one coefficient after the other, on rows ``v(m, n, x)`` with x the list of terms.

    For any number of terms; estimates only.
    """
    k = len(terms)
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""it AS (SELECT 0 AS step, list_transform(range(0, {k}), lambda i: 0.0::DOUBLE) AS b
    UNION ALL
    SELECT step + 1, list_transform(range(1, {k} + 1), lambda i: b[i] + CASE WHEN i = step % {k} + 1 THEN delta ELSE 0.0 END)
    FROM (SELECT step, b, sum((m - n * p) * x[step % {k} + 1]) / sum(n * p * (1 - p) * x[step % {k} + 1] * x[step % {k} + 1]) AS delta
        FROM (SELECT *, 1 / (1 + exp(-list_dot_product(b, x))) AS p FROM it, v WHERE step < {steps}) GROUP BY step, b))
    SELECT unnest([{names}]) AS term, round(unnest(b), 4) AS estimate FROM it WHERE step = {steps}"""


def standard(column: str) -> str:
    return f"(({column}) - avg({column}) OVER ()) / stddev_pop({column}) OVER ()"


MIXED_TERMS = {"(Intercept)": "1.0::DOUBLE"} | {
    f"income_level_{r}": f"CASE WHEN income_level = '{r}' THEN 1.0 ELSE 0.0 END::DOUBLE" for r in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
}


@query(
    "glm_mixed",
    f"""WITH RECURSIVE {CONTENT}, z AS (SELECT *, {standard('budget_mean')} AS budget, {standard('s_acctbal')} AS balance FROM content),
    v AS MATERIALIZED (SELECT m::DOUBLE AS m, n::DOUBLE AS n,
        [{', '.join(MIXED_TERMS.values())}, budget, balance] AS x FROM z), {ascent(MIXED_TERMS | {'budget': '', 'balance': ''})}""",
)
def glm_mixed(spark, folder):
    """One factor and two numbers, brought to mean 0 and deviation 1."""
    rows = content(spark, folder)
    s = rows.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("budget_mean", "s_acctbal") for f in (F.avg, F.stddev_pop)]).first()
    rows = rows.select(
        *COUNTS, "income_level",
        ((F.col("budget_mean") - s["budget_mean_avg"]) / s["budget_mean_stddev_pop"]).alias("budget"),
        ((F.col("s_acctbal") - s["s_acctbal_avg"]) / s["s_acctbal_stddev_pop"]).alias("balance"),
    )
    fitted = models.fit_binomial(rows, *COUNTS, ["income_level", "budget", "balance"])
    return _rounded(models.coefficient_table(spark, fitted).select("term", "estimate"), {"estimate": 4})


EIGHT = {"flag": "avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) > 0.3333", "status": "avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) > 0.5"}
EIGHT_NUMBERS = {"quantity": "avg(l_quantity)", "discount": "avg(l_discount)", "tax": "avg(l_tax)", "balance": "any_value(s_acctbal)", "budget_mean": "avg(l_extendedprice)"}


@query(
    "model_eight",
    f"""WITH RECURSIVE r AS (SELECT l_suppkey, any_value(r_name) AS income_level,
        CAST(sum(CASE WHEN p_type IN {MATURE_SQL} THEN 1 ELSE 0 END) AS DOUBLE) AS m, CAST(count(*) AS DOUBLE) AS n,
        {', '.join(f"CASE WHEN {e} THEN 'Y' ELSE 'N' END AS {c}" for c, e in EIGHT.items())},
        {', '.join(f'{e} AS {c}' for c, e in EIGHT_NUMBERS.items())}
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
    z AS (SELECT m, n, income_level, flag, status, {', '.join(f'{standard(c)} AS {c}' for c in EIGHT_NUMBERS)} FROM r),
    v AS MATERIALIZED (SELECT m, n, [{', '.join(MIXED_TERMS.values())},
        {', '.join(f"CASE WHEN {c} = 'Y' THEN 1.0 ELSE 0.0 END::DOUBLE" for c in EIGHT)}, {', '.join(EIGHT_NUMBERS)}] AS x FROM z),
    {ascent(MIXED_TERMS | {f'{c}_Y': '' for c in EIGHT} | dict.fromkeys(EIGHT_NUMBERS, ''), 12000)}""",
)
def model_eight(spark, folder):
    """Three factors and five numbers in one fit, as the source's final model has them."""
    part = table(spark, folder, "part").select("p_partkey", F.col("p_type").isin(GENRES).cast("int").alias("mature"))
    lines = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    numbers = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "budget_mean": "l_extendedprice"}
    counted = lines.groupBy("l_suppkey").agg(
        F.sum("mature").alias("maturecontent_sum"),
        F.sum(1 - F.col("mature")).alias("notmature_sum"),
        F.when(F.avg((F.col("l_returnflag") == "R").cast("double")) > 0.3333, "Y").otherwise("N").alias("flag"),
        F.when(F.avg((F.col("l_linestatus") == "O").cast("double")) > 0.5, "Y").otherwise("N").alias("status"),
        *[F.avg(c).alias(name) for name, c in numbers.items()],
    )
    rows = materialise(at_home(counted, spark, folder).withColumnRenamed("s_acctbal", "balance"), "eight")
    s = rows.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in EIGHT_NUMBERS for f in (F.avg, F.stddev_pop)]).first()
    rows = rows.withColumns({c: (F.col(c) - s[f"{c}_avg"]) / s[f"{c}_stddev_pop"] for c in EIGHT_NUMBERS})
    fitted = models.fit_binomial(rows, *COUNTS, ["income_level", *EIGHT, *EIGHT_NUMBERS])
    return _rounded(models.coefficient_table(spark, fitted).select("term", "estimate"), {"estimate": 4})


@query(
    "glm_many_levels",
    f"""WITH g AS (SELECT l_suppkey::VARCHAR AS k, CAST(sum(CASE WHEN p_type IN {MATURE_SQL} THEN 1 ELSE 0 END) AS DOUBLE) AS m,
        CAST(sum(CASE WHEN p_type IN {MATURE_SQL} THEN 0 ELSE 1 END) AS DOUBLE) AS o
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    f AS (SELECT ln(m / o) AS b0 FROM g WHERE k = (SELECT min(k) FROM g))
    SELECT CASE WHEN k = (SELECT min(k) FROM g) THEN '(Intercept)' ELSE 'supplier_' || k END AS term,
        round(CASE WHEN k = (SELECT min(k) FROM g) THEN b0 ELSE ln(m / o) - b0 END, 5) AS estimate FROM g, f""",
)
def glm_many_levels(spark, folder):
    """Every supplier a level of its own, on single order lines."""
    part = table(spark, folder, "part").select("p_partkey", F.col("p_type").isin(GENRES).cast("int").alias("mature"))
    lines = table(spark, folder, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("supplier"))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("mature", "supplier")
    fitted = factors.fit_factor(rows, "mature", 1 - F.col("mature"), "supplier")
    return _rounded(factors.factor_table(fitted).select("term", "estimate"), {"estimate": 5})


@query(
    "culture_model",
    f"""WITH RECURSIVE {FULL}, joined AS (SELECT production_countries_name,
        sum(CASE WHEN genres_name IN {MATURE_SQL} THEN 1.0 ELSE 0.0 END)::DOUBLE AS m, count(*)::DOUBLE AS n,
        any_value(ln(y * population / (y + n + u))) AS x1, any_value(pdi / 1000) AS x2
        FROM films JOIN wide ON production_countries_name = wide.country LEFT JOIN people USING (country)
        JOIN scores USING (country) WHERE year > {YEAR} GROUP BY 1),
    v AS MATERIALIZED (SELECT m, n, x1, x2 FROM joined WHERE x1 IS NOT NULL AND x2 IS NOT NULL),
    {newton(('extrapolated_genderY', 'pdi'))}""",
)
def culture_model(spark, folder):
    """From film and survey rows to the fitted model; countries without population are left out."""
    rows = culture.analysis_table(
        country_content(films(spark, folder), YEAR, GENRES),
        culture.countries_with_population(countries(spark, folder), population(spark, folder), YEAR),
        answers(spark, folder),
        scores(spark, folder).select("country", (F.col("pdi") / 1000).alias("pdi"), "idv"),
    )
    fitted = culture.fit_culture_model(materialise(rows, "model"), ["extrapolated_genderY", "pdi"])
    table_ = models.coefficient_table(spark, fitted).select("term", "estimate", "std_error")
    return _rounded(table_, {"estimate": 5, "std_error": 5})


LINES = f"""WITH content AS (SELECT r_name AS income_level, CASE WHEN p_type IN {MATURE_SQL} THEN 1 ELSE 0 END AS m,
    CASE WHEN p_type IN {MATURE_SQL} THEN 0 ELSE 1 END AS o, 1 AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    "glm_bernoulli",
    f"""{LINES}, {closed_form()} SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error,
        (SELECT round(-2 * sum(gm * ln(gm / gn) + go * ln(go / gn)), 3) FROM grp) AS deviance FROM coef""",
)
def glm_bernoulli(spark, folder):
    """0/1 rows: every order line, all columns but two as predictors."""
    part = table(spark, folder, "part").select("p_partkey", F.col("p_type").isin(GENRES).cast("int").alias("mature"))
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey")
    rows = at_home(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), spark, folder)
    rows = rows.select("mature", "income_level", "n_name", "l_suppkey")
    fitted = models.fit_bernoulli(rows, "mature", models.all_but(rows, "mature", "n_name", "l_suppkey"))
    table_ = models.coefficient_table(spark, fitted).select("term", "estimate", "std_error")
    return _rounded(table_.withColumn("deviance", F.lit(fitted.deviance)), {"estimate": 6, "std_error": 6, "deviance": 3})


@query(
    "design_matrix",
    f"""WITH {CONTENT} SELECT s_suppkey, 1.0::DOUBLE AS "(Intercept)", """
    + ", ".join(
        f"CASE WHEN income_level = '{r}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"income_level_{r}\""
        for r in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    )
    + ", round(budget_mean, 6) AS budget_mean FROM content",
)
def design_matrix(spark, folder):
    matrix = models.design_matrix(content(spark, folder), ["income_level", "budget_mean"], ["s_suppkey"])
    return _rounded(matrix, {"budget_mean": 6})


@query(
    "glm_summary",
    f"""{BASE}, total AS (SELECT CAST(sum(m) AS DOUBLE) AS tm, CAST(sum(o) AS DOUBLE) AS t_o, CAST(sum(n) AS DOUBLE) AS tn,
        count(*) AS rows FROM content),
    sat AS (SELECT sum(CASE WHEN m > 0 THEN m * ln(m / n) ELSE 0 END + CASE WHEN o > 0 THEN o * ln(o / n) ELSE 0 END) AS s,
        sum(m * ln(p) + o * ln(1 - p)) AS f, sum(lgamma(n + 1) - lgamma(m + 1) - lgamma(o + 1)) AS c FROM rws)
    SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error, round(b / se, 4) AS z, round({normal_p('b / se')}, 6) AS p_value,
        round(2 * (s - tm * ln(tm / tn) - t_o * ln(t_o / tn)), 4) AS null_deviance, rows - 1 AS null_df,
        round(2 * (s - f), 4) AS residual_deviance, rows - (SELECT count(*) FROM coef) AS residual_df,
        round(-2 * (c + f) + 2 * (SELECT count(*) FROM coef), 4) AS aic FROM coef, total, sat""",
)
def glm_summary(spark, folder):
    _, fitted = fit(spark, folder)
    measures = models.fit_measures(spark, fitted).first().asDict()
    rows = models.coefficient_table(spark, fitted).withColumns({k: F.lit(v) for k, v in measures.items()})
    rows = rows.withColumns({k: F.col(k).cast("long") for k in ("null_df", "residual_df")})
    digits = {"estimate": 6, "std_error": 6, "z": 4, "p_value": 6, "null_deviance": 4, "residual_deviance": 4, "aic": 4}
    return _rounded(rows, digits)


@query(
    "predict_class",
    f"""WITH {CONTENT}, known AS (SELECT * FROM content WHERE income_level <> 'EUROPE'), {closed_form('known')}
    SELECT s_suppkey, round(gm / gn, 6) AS probability,
        CASE WHEN gm / gn > 0.32 THEN 'pos' WHEN gm / gn <= 0.32 THEN 'neg' END AS predicted_class
    FROM content LEFT JOIN grp USING (income_level)""",
)
def predict_class(spark, folder):
    """Suppliers of one region have a missing predictor: they are not fitted and keep a missing prediction."""
    rows = content(spark, folder).withColumn("income_level", F.nullif("income_level", F.lit("EUROPE")))
    fitted = models.fit_binomial(rows, *COUNTS, ["income_level"])
    scored = models.predict_class(rows, fitted, 0.32)
    return _rounded(scored.select("s_suppkey", "probability", "predicted_class"), {"probability": 6})


@query(
    "linearity_long",
    f"{BASE} "
    + " UNION ALL ".join(
        f"SELECT s_suppkey, round(ln(p / (1 - p)), 6) AS logit, '{c}' AS predictors, round({e}, 6) AS predictor_value FROM rws"
        for c, e in (("s_acctbal", "s_acctbal"), ("budget_mean", "budget_mean"), ("probability", "p"))
    ),
)
def linearity_long(spark, folder):
    rows, fitted = fit(spark, folder)
    scored = rows.select("s_suppkey", "s_acctbal", "budget_mean", fitted.probability().alias("probability"))
    long = diagnostics.linearity_long(scored, "probability", ["s_acctbal", "budget_mean", "probability"], ["s_suppkey"])
    return _rounded(long, {"logit": 6, "predictor_value": 6})


MEASURES = ["budget_mean", "s_acctbal", "trials"]
MEASURED = f"""WITH {CONTENT}, v AS (SELECT budget_mean, s_acctbal, CAST(n AS DOUBLE) AS trials FROM content)"""


def measured(spark, folder):
    trials = (F.col("maturecontent_sum") + F.col("notmature_sum")).alias("trials")
    return content(spark, folder).select("budget_mean", "s_acctbal", trials)


@query(
    "corr_matrix",
    f"{MEASURED} "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM v" for x in MEASURES for y in MEASURES
    ),
)
def corr_matrix(spark, folder):
    return _rounded(diagnostics.correlation_matrix(measured(spark, folder), MEASURES), {"r": 6})


@query(
    "ols_fit",
    f"""{MEASURED}, s AS (SELECT count(*) AS n, avg(s_acctbal) AS my, avg(budget_mean) AS m1, avg(trials) AS m2,
        var_pop(budget_mean) * count(*) AS s11, var_pop(trials) * count(*) AS s22, covar_pop(budget_mean, trials) * count(*) AS s12,
        covar_pop(budget_mean, s_acctbal) * count(*) AS s1y, covar_pop(trials, s_acctbal) * count(*) AS s2y,
        var_pop(s_acctbal) * count(*) AS syy FROM v),
    d AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
        (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
    e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS v FROM d),
    c AS (SELECT '(Intercept)' AS term, b0 AS b, sqrt(v * (1.0 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det)) AS se,
            1 - v * (n - 3) / syy AS r2, v, n FROM e
        UNION ALL SELECT 'budget_mean', b1, sqrt(v * s22 / det), 1 - v * (n - 3) / syy, v, n FROM e
        UNION ALL SELECT 'trials', b2, sqrt(v * s11 / det), 1 - v * (n - 3) / syy, v, n FROM e)
    SELECT term, round(b, 3) AS estimate, round(se, 3) AS std_error, round(b / se, 5) AS t,
        round({student_p('b / se', '(n - 3)')}, 6) AS p_value, round(r2, 6) AS r2,
        round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adjusted_r2, round(sqrt(v), 3) AS sigma,
        round((r2 / 2) / ((1 - r2) / (n - 3)), 5) AS f_statistic, CAST(n - 3 AS BIGINT) AS residual_df FROM c""",
)
def ols_fit(spark, folder):
    """The table of a linear model with what its summary prints below."""
    fitted = models.fit_linear(measured(spark, folder), "s_acctbal", ["budget_mean", "trials"])
    measures = models.linear_measures(spark, fitted).first().asDict()
    rows = models.linear_table(spark, fitted).withColumns({k: F.lit(v) for k, v in measures.items()})
    rows = rows.withColumn("residual_df", F.col("residual_df").cast("long"))
    digits = {"estimate": 3, "std_error": 3, "t": 5, "p_value": 6, "r2": 6, "adjusted_r2": 6, "sigma": 3, "f_statistic": 5}
    return _rounded(rows, digits)


@query(
    "vif",
    f"""{MEASURED}, r AS (SELECT corr(budget_mean, trials) AS r FROM v)
    SELECT term, round(1 - r * r, 6) AS tolerance, round(1 / (1 - r * r), 6) AS vif
    FROM r, (SELECT 'budget_mean' AS term UNION ALL SELECT 'trials')""",
)
def vif(spark, folder):
    rows = diagnostics.variance_inflation(measured(spark, folder), ["budget_mean", "trials"])
    return _rounded(rows, {"tolerance": 6, "vif": 6})


@query(
    "gvif",
    f"""WITH {CONTENT}, w AS (SELECT sum(ss) AS within_ss, count(*) AS levels FROM (
            SELECT var_pop(budget_mean) * count(*) AS ss FROM content GROUP BY income_level)),
    g AS (SELECT (SELECT var_pop(budget_mean) * count(*) FROM content) / within_ss AS v, levels FROM w)
    SELECT 'income_level' AS predictor, CAST(levels - 1 AS INTEGER) AS df, round(v, 6) AS gvif,
        round(pow(v, 1.0 / (2 * (levels - 1))), 6) AS scaled FROM g
    UNION ALL SELECT 'budget_mean', 1, round(v, 6), round(sqrt(v), 6) FROM g""",
)
def gvif(spark, folder):
    """A factor beside a number: both inflate by total over within-level variation."""
    rows = diagnostics.generalised_inflation(content(spark, folder), ["income_level", "budget_mean"])
    return _rounded(rows, {"gvif": 6, "scaled": 6})


@query(
    "collinearity_diag",
    f"""{MEASURED}, r AS (SELECT sum(trials) / sqrt(count(*) * sum(trials * trials)) AS r FROM v),
    l AS (SELECT 1 AS dimension, 1 + r AS e, 1.0::DOUBLE AS ci, (1 - r) / 2 AS share FROM r
        UNION ALL SELECT 2, 1 - r, sqrt((1 + r) / (1 - r)), (1 + r) / 2 FROM r)
    SELECT dimension, round(e, 6) AS eigenvalue, round(ci, 4) AS condition_index, term, round(share, 6) AS variance_share
    FROM l, (SELECT '(Intercept)' AS term UNION ALL SELECT 'trials')""",
)
def collinearity_diag(spark, folder):
    rows = diagnostics.collinearity_table(measured(spark, folder), ["trials"])
    return _rounded(rows, {"eigenvalue": 6, "condition_index": 4, "variance_share": 6})


@query(
    "augment",
    f"""{DIAG} SELECT s_suppkey, round(link_fitted, 6) AS link_fitted, round(p, 6) AS fitted, round(resid, 6) AS resid,
        round(h, 6) AS hat, round(std_resid, 6) AS std_resid, round(cooksd, 6) AS cooksd,
        CASE WHEN h < 1 THEN round(sqrt(((SELECT sum(d) FROM unit) - d / (1 - h))
            / ((SELECT count(*) FROM unit) - (SELECT count(*) FROM grp) - 1)), 6) END AS sigma FROM aug""",
)
def augment(spark, folder):
    rows, fitted = fit(spark, folder)
    columns = ["link_fitted", "fitted", "resid", "hat", "std_resid", "cooksd", "sigma"]
    augmented = diagnostics.augment(rows, fitted).select("s_suppkey", *columns)
    return _rounded(augmented, {c: 6 for c in columns})


TOP = f"""{DIAG}, top AS (SELECT s_suppkey, c FROM (SELECT s_suppkey, round(cooksd, 8) AS c,
    rank() OVER (ORDER BY round(cooksd, 8) DESC) AS r FROM aug WHERE cooksd IS NOT NULL) WHERE r <= {INFLUENTIAL_ROWS})"""


@query("influence_top3", f"{TOP} SELECT s_suppkey, c AS cooksd FROM top")
def influence_top3(spark, folder):
    rows, fitted = fit(spark, folder)
    top = diagnostics.influential_rows(diagnostics.augment(rows, fitted), INFLUENTIAL_ROWS)
    return top.select("s_suppkey", "cooksd")


@query(
    "residual_band",
    f"{DIAG} SELECT s_suppkey, round(std_resid, 6) AS std_resid, abs(std_resid) > {RESIDUAL_BAND} AS outside FROM aug",
)
def residual_band(spark, folder):
    rows, fitted = fit(spark, folder)
    banded = diagnostics.residual_band(diagnostics.augment(rows, fitted), RESIDUAL_BAND)
    return _rounded(banded.select("s_suppkey", "std_resid", "outside"), {"std_resid": 6})


def _renamed_closed_form() -> str:
    """A second closed form beside the first, on the rows that stay."""
    text = closed_form("kept")
    for name in ("grp", "ref", "coef", "rws"):
        text = text.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name}", f"FROM {name}2")
    return text.replace("grp2, ref ", "grp2, ref2 ").replace("JOIN grp ", "JOIN grp2 ")


@query(
    "refit_without",
    f"""{TOP}, kept AS (SELECT * FROM content WHERE s_suppkey NOT IN (SELECT s_suppkey FROM top)), {_renamed_closed_form()}
    SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error FROM coef2""",
)
def refit_without(spark, folder):
    rows, fitted = fit(spark, folder)
    top = diagnostics.influential_rows(diagnostics.augment(rows, fitted), INFLUENTIAL_ROWS)
    again = diagnostics.refit_without(rows, top, "s_suppkey", fitted)
    table_ = models.coefficient_table(spark, again).select("term", "estimate", "std_error")
    return _rounded(table_, {"estimate": 6, "std_error": 6})


@query(
    "ci_wald",
    f"""{BASE} SELECT term, round(b, 6) AS estimate, round(b - {inference.Z_95!r} * se, 6) AS lower,
        round(b + {inference.Z_95!r} * se, 6) AS upper FROM coef""",
)
def ci_wald(spark, folder):
    _, fitted = fit(spark, folder)
    return _rounded(inference.wald_intervals(spark, fitted), {"estimate": 6, "lower": 6, "upper": 6})


@query(
    "ci_profile",
    f"""WITH RECURSIVE {CONTENT}, {closed_form()},
    two AS (SELECT 'income_level_' || income_level AS term, gm AS m1, go AS o1, gn AS n1, rm AS m0, ro AS o0, rn AS n0,
            ln(gm / go) - ln(rm / ro) AS b, sqrt(1 / gm + 1 / go + 1 / rm + 1 / ro) AS se,
            gm * ln(gm / gn) + go * ln(go / gn) + rm * ln(rm / rn) + ro * ln(ro / rn) AS best
        FROM grp, ref WHERE income_level <> ref_level
        UNION ALL SELECT '(Intercept)', 0, 0, 0, rm, ro, rn, ln(rm / ro), sqrt(1 / rm + 1 / ro),
            rm * ln(rm / rn) + ro * ln(ro / rn) FROM ref),
    search AS (SELECT term AS of, 0 AS step, s.side, two.b AS inner_end, two.b + s.side * 8 * se AS outer_end FROM two, (VALUES (-1), (1)) s(side)
        UNION ALL
        SELECT of, step + 1, side, CASE WHEN rise < {inference.CHI2_95!r} THEN middle ELSE inner_end END,
               CASE WHEN rise < {inference.CHI2_95!r} THEN outer_end ELSE middle END
        FROM (SELECT of, step, side, inner_end, outer_end, middle,
                2 * (best - CASE WHEN of = '(Intercept)' THEN m0 * ln(c / (1 + c)) - o0 * ln(1 + c)
                    ELSE m0 * ln(t / (1 + t)) - o0 * ln(1 + t) + m1 * ln(c * t / (1 + c * t)) - o1 * ln(1 + c * t) END) AS rise
            FROM (SELECT *, CASE WHEN of = '(Intercept)' THEN 1 ELSE (-qb + sqrt(qb * qb + 4 * qa * (m0 + m1))) / (2 * qa) END AS t
                FROM (SELECT *, c * (n0 + n1 - m0 - m1) AS qa, n0 + n1 * c - (m0 + m1) * (1 + c) AS qb
                    FROM (SELECT *, (inner_end + outer_end) / 2 AS middle, exp((inner_end + outer_end) / 2) AS c
                        FROM search JOIN two ON of = term WHERE step < 60))))),
    ends AS (SELECT of, max(CASE WHEN side = -1 THEN inner_end END) AS lower, max(CASE WHEN side = 1 THEN inner_end END) AS upper
        FROM search WHERE step = 60 GROUP BY of)
    SELECT term, round(b, 5) AS estimate, round(lower, 5) AS lower, round(upper, 5) AS upper FROM two JOIN ends ON of = term""",
)
def ci_profile(spark, folder):
    """Every coefficient; all ends are sought in the same passes."""
    rows, fitted = fit(spark, folder)
    return _rounded(inference.profile_intervals(rows, fitted), {"estimate": 5, "lower": 5, "upper": 5})


@query(
    "odds_ratio",
    f"""{BASE} SELECT term, round(exp(b), 6) AS odds_ratio, round(exp(b - {inference.Z_95!r} * se), 6) AS lower,
        round(exp(b + {inference.Z_95!r} * se), 6) AS upper FROM coef""",
)
def odds_ratio(spark, folder):
    _, fitted = fit(spark, folder)
    return _rounded(inference.odds_ratios(spark, fitted), {"odds_ratio": 6, "lower": 6, "upper": 6})


@query(
    "glm_null",
    f"""WITH {CONTENT} SELECT '(Intercept)' AS term, round(ln(sum(m) / sum(o)), 6) AS estimate,
        round(sqrt(1 / sum(m) + 1 / sum(o)), 6) AS std_error FROM content""",
)
def glm_null(spark, folder):
    fitted = inference.null_model(content(spark, folder), *COUNTS)
    table_ = models.coefficient_table(spark, fitted).select("term", "estimate", "std_error")
    return _rounded(table_, {"estimate": 6, "std_error": 6})


@query(
    "lr_test",
    f"""{BASE}, d AS (SELECT 2 * (sum(gm * ln(gm / gn) + go * ln(go / gn))
        - sum(gm) * ln(sum(gm) / sum(gn)) - sum(go) * ln(sum(go) / sum(gn))) AS drop, count(*) - 1 AS df FROM grp)
    SELECT CAST(df AS INTEGER) AS df, round(drop, 4) AS deviance_drop, round(exp(-drop / 2) * (1 + drop / 2), 6) AS p_value FROM d""",
)
def lr_test(spark, folder):
    """Five regions give four degrees of freedom, where the chi-square tail has a closed form."""
    rows, full = fit(spark, folder)
    small = inference.null_model(rows, *COUNTS)
    return _rounded(inference.likelihood_ratio(spark, small, full), {"deviance_drop": 4, "p_value": 6})


@query(
    "var_importance",
    f"{BASE} SELECT term, round(abs(b / se), 4) AS importance FROM coef WHERE term <> '(Intercept)'",
)
def var_importance(spark, folder):
    _, fitted = fit(spark, folder)
    return _rounded(inference.variable_importance(spark, fitted), {"importance": 4})


@query(
    "residual_plot_data",
    f"""{DIAG} SELECT s_suppkey, round(link_fitted, 6) AS link_fitted, round(resid, 6) AS resid, round(std_resid, 6) AS std_resid,
        round(sqrt(abs(std_resid)), 6) AS scale_location, round(h, 6) AS hat, round(pearson, 6) AS resid_pearson,
        round(cooksd, 6) AS cooksd FROM aug""",
)
def residual_plot_data(spark, folder):
    rows, fitted = fit(spark, folder)
    plotted = diagnostics.residual_plot_rows(diagnostics.augment(rows, fitted), "s_suppkey")
    return _rounded(plotted, {c: 6 for c in plotted.columns if c != "s_suppkey"})
