"""Models with a factor of many levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators import factors
from folkscope.queries.analogs import GENRES, MATURE_SQL
from folkscope.queries.registry import query
from folkscope.sources.tables import table

LINES = f"""v AS MATERIALIZED (SELECT l_suppkey AS level, CASE WHEN p_type IN {MATURE_SQL} THEN 1.0 ELSE 0.0 END::DOUBLE AS m,
    (l_quantity - 25) / 10 AS x FROM lineitem JOIN part ON l_partkey = p_partkey)"""

#: Newton steps for an intercept per level and one number: the levels are eliminated, the number's step comes from what is left.
ARROW = f"""{LINES}, it AS (SELECT 0 AS k, level, 0.0::DOUBLE AS alpha, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS rest
        FROM (SELECT DISTINCT level FROM v)
    UNION ALL
    SELECT k + 1, level, alpha + (s - b * step) / a, beta + step, a, b, rest
    FROM (SELECT *, sum(t - b * s / a) OVER () / sum(c - b * b / a) OVER () AS step, sum(c - b * b / a) OVER () AS rest
        FROM (SELECT k, level, alpha, beta, sum(m - p) AS s, sum(p * (1 - p)) AS a, sum(p * (1 - p) * x) AS b,
                sum(p * (1 - p) * x * x) AS c, sum((m - p) * x) AS t
            FROM (SELECT it.k, it.level, alpha, beta, m, x, 1 / (1 + exp(-(alpha + beta * x))) AS p
                FROM it JOIN v ON it.level = v.level WHERE it.k < 12)
            GROUP BY k, level, alpha, beta))),
fitted AS (SELECT level, alpha, beta, a, b / a AS q, rest, min(level) OVER () AS first FROM it WHERE k = 12)"""


def lines(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.col("p_type").isin(GENRES).cast("int").alias("mature"))
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", ((F.col("l_quantity") - 25) / 10).alias("quantity"))
    return rows.join(part, F.col("l_partkey") == F.col("p_partkey")).select("mature", F.col("l_suppkey").alias("supplier"), "quantity")


def fit(spark, folder):
    rows = lines(spark, folder)
    return rows, factors.fit_factor(rows, "mature", 1 - F.col("mature"), "supplier", ["quantity"])


@query(
    "glm_factor_number",
    f"""WITH RECURSIVE {ARROW}
    SELECT CASE WHEN f.level = f.first THEN '(Intercept)' ELSE 'supplier_' || f.level END AS term,
        round(f.alpha - CASE WHEN f.level = f.first THEN 0 ELSE r.alpha END, 5) AS estimate,
        round(sqrt(CASE WHEN f.level = f.first THEN 1 / f.a + f.q * f.q / f.rest
            ELSE 1 / f.a + 1 / r.a + (f.q - r.q) * (f.q - r.q) / f.rest END), 5) AS std_error
    FROM fitted f JOIN fitted r ON r.level = f.first
    UNION ALL SELECT 'quantity', round(any_value(beta), 5), round(1 / sqrt(any_value(rest)), 5) FROM fitted""",
)
def glm_factor_number(spark, folder):
    """Every supplier a level of its own beside a number, on single order lines."""
    _, fitted = fit(spark, folder)
    table_ = factors.factor_table(fitted).select("term", "estimate", "std_error")
    return table_.withColumns({c: F.round(c, 5) for c in ("estimate", "std_error")})


@query(
    "augment_factor",
    f"""WITH RECURSIVE {ARROW}, rws AS (SELECT *, p * (1 - p) * (1 / a + (x - q) * (x - q) / rest) AS h
        FROM (SELECT f.*, m, x, 1 / (1 + exp(-(alpha + beta * x))) AS p FROM fitted f JOIN v ON f.level = v.level))
    SELECT level AS supplier, count(*) AS n, round(sum(p), 5) AS fitted, round(sum(h), 6) AS hat, round(max(h), 7) AS most_hat,
        round(max((m - p) * (m - p) / (p * (1 - p)) * h / ((1 - h) * (1 - h) * (SELECT count(*) + 1 FROM fitted))), 7) AS most_cooksd
    FROM rws GROUP BY 1""",
)
def augment_factor(spark, folder):
    """Leverage and influence of single order lines in that model, summed up per supplier."""
    rows, fitted = fit(spark, folder)
    return factors.augment_factor(rows, fitted).groupBy("supplier").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("fitted"), 5).alias("fitted"),
        F.round(F.sum("hat"), 6).alias("hat"),
        F.round(F.max("hat"), 7).alias("most_hat"),
        F.round(F.max("cooksd"), 7).alias("most_cooksd"),
    )
