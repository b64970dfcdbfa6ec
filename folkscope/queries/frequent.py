"""Frequent values by candidates; least squares by orthogonal steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators import frequent, leastsquares, models
from folkscope.queries.profiles import TEXTS
from folkscope.queries.registry import query
from folkscope.sources.tables import table


@query(
    "frequent_values",
    "WITH counts AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2" for c in TEXTS
    )
    + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank,
        sum(n) OVER (PARTITION BY feature) AS valid FROM counts)
    SELECT feature, CAST(rank AS INTEGER) AS rank, value, n, round(n / valid, 8) AS share FROM ranked WHERE rank <= 10""",
)
def frequent_values(spark, folder):
    found = frequent.frequent_values(table(spark, folder, "lineitem"), TEXTS)
    return found.withColumn("share", F.round("share", 8))


#: The response on a number and what a nearly equal one adds to it, which is well conditioned; the near one's terms follow.
NEAR = 1e-6
APART = f"""WITH v AS (SELECT l_extendedprice / 1000 AS y, l_quantity / 10 AS x, l_discount * 10 + l_tax AS z FROM lineitem),
c AS (SELECT avg(y) AS my, avg(x) AS mx, avg(z) AS mz FROM v),
s AS (SELECT count(*) AS n, sum((x - mx) * (x - mx)) AS xx, sum((z - mz) * (z - mz)) AS zz, sum((x - mx) * (z - mz)) AS xz,
    sum((x - mx) * (y - my)) AS xy, sum((z - mz) * (y - my)) AS zy, sum((y - my) * (y - my)) AS yy FROM v, c),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz, xx * zz - xz * xz AS det FROM s),
e AS (SELECT *, sqrt((yy - bx * xy - bz * zy) / (n - 3)) AS sigma FROM b)"""


def nearly_equal(spark, folder):
    """Two numbers that differ by a millionth: sums of squares keep no digit of their difference."""
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_quantity") / 10).alias("x"),
        (F.col("l_quantity") / 10 + NEAR * (F.col("l_discount") * 10 + F.col("l_tax"))).alias("near"),
    )
    return rows


@query(
    "ols_qr",
    f"""{APART} SELECT 'x' AS term, round(-bz, 4) AS estimate, round(sigma * sqrt(xx / det), 4) AS std_error FROM e
    UNION ALL SELECT 'near', round(bz, 4), round(sigma * sqrt(xx / det), 4) FROM e
    UNION ALL SELECT '(Intercept)', round(my - bx * mx - bz * mz, 4), NULL FROM e, c""",
)
def ols_qr(spark, folder):
    """Estimates in millions where they belong to the nearly equal pair."""
    fitted = leastsquares.fit_linear_qr(nearly_equal(spark, folder), "y", ["x", "near"])
    found = models.linear_table(spark, fitted).select("term", "estimate", "std_error")
    scale = F.when(F.col("term") == "(Intercept)", 1.0).otherwise(NEAR)
    error = F.when(F.col("term") != "(Intercept)", F.round(F.col("std_error") * scale, 4))
    return found.select("term", F.round(F.col("estimate") * scale, 4).alias("estimate"), error.alias("std_error"))


@query(
    "inflation_qr",
    f"""{APART} SELECT 'near' AS term, round((zz + (xx + 2e-6 * xz) * 1e12) * xx / det * 1e-12, 4) AS inflation FROM e
    UNION ALL SELECT 'x', round(xx * (xx * 1e12 + 2e6 * xz + zz) / det * 1e-12, 4) FROM e""",
)
def inflation_qr(spark, folder):
    """Variance inflation of the nearly equal pair, in millions of millions."""
    triangle = leastsquares.factorise(nearly_equal(spark, folder), "y", ["x", "near"])
    rows = [(term, round(value * NEAR**2, 4)) for term, value in leastsquares.inflation(triangle).items()]
    return spark.createDataFrame(rows, "term string, inflation double")
