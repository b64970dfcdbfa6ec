"""Fits from formula text."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators import formulas, models
from folkscope.queries.models import CONTENT, _rounded, content
from folkscope.queries.registry import query

#: An intercept and a slope per region, by Newton steps within each; every coding of them follows.
LINES = f"""WITH RECURSIVE {CONTENT}, v AS MATERIALIZED (SELECT income_level AS g, m::DOUBLE AS m, n::DOUBLE AS n, s_acctbal / 1000 AS x FROM content),
it AS (SELECT 0 AS k, g, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 1.0::DOUBLE AS v0, 1.0::DOUBLE AS v1 FROM (SELECT DISTINCT g FROM v)
    UNION ALL
    SELECT k + 1, g, b0 + (d * s0 - c * s1) / det, b1 + (a * s1 - c * s0) / det, d / det, a / det
    FROM (SELECT *, a * d - c * c AS det FROM (
        SELECT k, g, b0, b1, sum(r) AS s0, sum(r * x) AS s1, sum(w) AS a, sum(w * x) AS c, sum(w * x * x) AS d
        FROM (SELECT it.k, it.g, b0, b1, x, m - n * p AS r, n * p * (1 - p) AS w
            FROM (SELECT it.k, it.g, b0, b1, x, m, n, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it JOIN v ON it.g = v.g WHERE it.k < 25) AS it)
        GROUP BY k, g, b0, b1))),
fits AS (SELECT *, g = min(g) OVER () AS base FROM it WHERE k = 25)"""


def rows(spark, folder):
    return content(spark, folder).withColumn("balance", F.col("s_acctbal") / 1000)


def table_of(spark, fitted):
    return _rounded(models.coefficient_table(spark, fitted).select("term", "estimate", "std_error"), {"estimate": 5, "std_error": 5})


@query(
    "glm_formula",
    f"""{LINES}, r AS (SELECT b0 AS r0, b1 AS r1, v0 AS w0, v1 AS w1 FROM fits WHERE base)
    SELECT '(Intercept)' AS term, round(r0, 5) AS estimate, round(sqrt(w0), 5) AS std_error FROM r
    UNION ALL SELECT 'balance', round(r1, 5), round(sqrt(w1), 5) FROM r
    UNION ALL SELECT 'income_level_' || g, round(b0 - r0, 5), round(sqrt(v0 + w0), 5) FROM fits, r WHERE NOT base
    UNION ALL SELECT 'income_level_' || g || ':balance', round(b1 - r1, 5), round(sqrt(v1 + w1), 5) FROM fits, r WHERE NOT base""",
)
def glm_formula(spark, folder):
    """A factor, a number and their interaction, against the first level."""
    return table_of(spark, formulas.fit_formula(rows(spark, folder), "cbind(maturecontent_sum, notmature_sum) ~ income_level * balance"))


@query(
    "glm_formula_nested",
    f"""{LINES} SELECT 'income_level_' || g AS term, round(b0, 5) AS estimate, round(sqrt(v0), 5) AS std_error FROM fits
    UNION ALL SELECT 'income_level_' || g || ':balance', round(b1, 5), round(sqrt(v1), 5) FROM fits""",
)
def glm_formula_nested(spark, folder):
    """No intercept and the number within the factor: a column per level of both."""
    return table_of(spark, formulas.fit_formula(rows(spark, folder), "cbind(maturecontent_sum, notmature_sum) ~ income_level / balance - 1"))


@query(
    "glm_formula_dot",
    f"""{LINES}, r AS (SELECT b0 AS r0, b1 AS r1, v0 AS w0, v1 AS w1 FROM fits WHERE base)
    SELECT 'income_level_' || g AS term, round(b0, 5) AS estimate FROM fits
    UNION ALL SELECT 'balance', round(r1, 5) FROM r
    UNION ALL SELECT 'income_level_' || g || ':balance', round(b1 - r1, 5) FROM fits, r WHERE NOT base""",
)
def glm_formula_dot(spark, folder):
    """All other columns but some, an interaction on top, and no intercept."""
    some = rows(spark, folder).select("maturecontent_sum", "notmature_sum", "income_level", "balance", "s_suppkey")
    fitted = formulas.fit_formula(some, "cbind(maturecontent_sum, notmature_sum) ~ . - s_suppkey + income_level:balance - 1")
    return table_of(spark, fitted).drop("std_error")
