"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators import joins
from folkscope.operators.aggregates import majority, weighted_shares
from folkscope.operators.ordering import bind_columns
from folkscope.operators.survey import answer_chart, collapse_levels
from folkscope.plans import culture
from folkscope.plans.films import country_content, mature_flags, recent_films
from folkscope.queries.analogs import (
    COUNTRIES,
    FILMS,
    GENRES,
    MATURE_SQL,
    PRIORITIES,
    SCORES,
    SHARES,
    YEAR,
    YES,
    YES_SQL,
    countries,
    films,
    scores,
    survey,
)
from folkscope.queries.registry import query
from folkscope.sources.tables import table


def population(spark, folder):
    """Orders per country and year stand for inhabitants; one region has no figures."""
    orders = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    rows = orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = rows.filter("n_regionkey <> 3").groupBy(F.col("n_name").alias("country"), "year")
    return known.agg(F.count(F.lit(1)).alias("population"))


@query(
    "join_left",
    "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def join_left(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    return documents.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")


@query(
    "join_left_named",
    """SELECT s_suppkey, s_nationkey, n_name FROM supplier
    LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey""",
)
def join_left_named(spark, folder):
    """Nations of some regions are unknown to the dimension, so unmatched keys occur."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, folder, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name")
    return joins.join_named(suppliers, nations, "s_nationkey", "n_nationkey", "left")


@query(
    "join_inner_named",
    """SELECT l_suppkey, l_orderkey, s_name, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_acctbal > 5000""",
)
def join_inner_named(spark, folder):
    """Order lines of solvent suppliers: the condition on the dimension makes the join drop rows."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice")
    suppliers = table(spark, folder, "supplier").filter("s_acctbal > 5000").select("s_suppkey", "s_name")
    return joins.join_named(lines, suppliers, "l_suppkey", "s_suppkey", "inner")


@query(
    "join_natural_left",
    f"""WITH {COUNTRIES}, population AS (SELECT n_name AS country, count(*) AS population FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE year(o_orderdate) = {YEAR} AND n_regionkey <> 3 GROUP BY 1)
    SELECT * FROM countries NATURAL LEFT JOIN population""",
)
def join_natural_left(spark, folder):
    """Population figures come for several years; one is picked before the join."""
    return culture.countries_with_population(countries(spark, folder), population(spark, folder), YEAR)


@query(
    "join_natural_inner",
    """WITH top AS (SELECT c_nationkey, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1)
    SELECT c_custkey, c_nationkey, c_acctbal FROM customer JOIN top USING (c_nationkey, c_acctbal)""",
)
def join_natural_inner(spark, folder):
    """The shared columns include a measured number; both sides hold the very same stored value."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    top = customers.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("c_acctbal"))
    return joins.join_natural(customers, top, "inner").select("c_custkey", "c_nationkey", "c_acctbal")


@query(
    "join_map_attributes",
    f"""WITH {SCORES}, shapes AS (SELECT 'C' || n_nationkey AS ctr, n_name AS name FROM nation)
    SELECT ctr, name, round(pdi, 4) AS pdi, round(ltowvs, 4) AS ltowvs, ivr FROM shapes JOIN scores USING (ctr)
    WHERE pdi IS NOT NULL AND ltowvs IS NOT NULL AND ivr IS NOT NULL""",
)
def join_map_attributes(spark, folder):
    shapes = table(spark, folder, "nation").select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("ctr"), F.col("n_name").alias("name")
    )
    kept = scores(spark, folder).select("ctr", "pdi", "ltowvs", "ivr").dropna(subset=["pdi", "ltowvs", "ivr"])
    joined = shapes.join(kept, "ctr")
    return joined.select("ctr", "name", F.round("pdi", 4).alias("pdi"), F.round("ltowvs", 4).alias("ltowvs"), "ivr")


@query(
    "sql_left_join_using",
    f"""WITH {SHARES}, {COUNTRIES} SELECT country, CASE WHEN answer IN {YES_SQL} THEN 'Yes' ELSE 'No' END AS answer,
        round(CASE WHEN answer IN {YES_SQL} THEN weighted_estimate ELSE -weighted_estimate END, 8) AS response,
        income_level FROM shares LEFT JOIN (SELECT * FROM countries WHERE income_level <> 'ASIA') USING (country)""",
)
def sql_left_join_using(spark, folder):
    """Countries of one region have no level, so unmatched countries occur."""
    shares = weighted_shares(survey(spark, folder), "country", "answer")
    known = countries(spark, folder).filter("income_level <> 'ASIA'").select("country", "income_level")
    return answer_chart(shares, known, "answer", YES).withColumn("response", F.round("response", 8))


@query(
    "bind_columns",
    """WITH a AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i, c_custkey FROM customer),
    b AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i, o_orderkey FROM orders)
    SELECT c_custkey, o_orderkey FROM a JOIN b USING (i)""",
)
def bind_columns_query(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    bound = bind_columns(customers, orders, ["c_acctbal", "c_custkey"], ["o_totalprice", "o_orderkey"])
    return bound.select("c_custkey", "o_orderkey")


@query(
    "join_star_chain",
    f"""WITH {FILMS}, {COUNTRIES}, {SHARES}, {SCORES}, content AS (
        SELECT production_countries_name, round_even(avg(budget) / 1000, 2) AS budget_mean,
               CAST(sum(CASE WHEN genres_name IN {MATURE_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS maturecontent_sum,
               CAST(sum(CASE WHEN genres_name IN {MATURE_SQL} THEN 0 ELSE 1 END) AS BIGINT) AS notmature_sum
        FROM films WHERE year > {YEAR} GROUP BY 1),
    best AS (SELECT country, answer FROM (SELECT *, rank() OVER (PARTITION BY country ORDER BY weighted_estimate DESC) AS r
             FROM shares) WHERE r = 1)
    SELECT production_countries_name, budget_mean, maturecontent_sum, notmature_sum, iso3c, income_level, answer,
           round(pdi, 4) AS pdi, idv FROM content
    LEFT JOIN countries ON production_countries_name = countries.country
    JOIN best ON production_countries_name = best.country JOIN scores ON production_countries_name = scores.country""",
)
def join_star_chain(spark, folder):
    """Film rows are totalled per country before any dimension is joined."""
    content = country_content(films(spark, folder), YEAR, GENRES)
    best = majority(weighted_shares(survey(spark, folder), "country", "answer"), "country", "weighted_estimate")
    chain = joins.country_chain(
        content,
        countries(spark, folder),
        best.select("country", "answer"),
        scores(spark, folder).select("country", F.round("pdi", 4).alias("pdi"), "idv"),
        "production_countries_name",
    )
    return chain


FULL = f"""{FILMS}, {COUNTRIES}, {SHARES}, {SCORES}, people AS (SELECT n_name AS country, count(*) AS population FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE year(o_orderdate) = {YEAR} AND n_regionkey <> 3 GROUP BY 1),
wide AS (SELECT country, sum(CASE WHEN answer IN ('1-URGENT', '2-HIGH') THEN weighted_n END) AS y,
    sum(CASE WHEN answer IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN weighted_n END) AS n,
    sum(CASE WHEN answer = '5-LOW' THEN weighted_n END) AS u FROM shares GROUP BY 1),
best AS (SELECT country, answer FROM (SELECT *, rank() OVER (PARTITION BY country ORDER BY weighted_estimate DESC) AS r
    FROM shares) WHERE r = 1)"""


def answers(spark, folder):
    """Merged answer counts and the majority answer per country."""
    shares = weighted_shares(survey(spark, folder), "country", "answer")
    names = dict(zip(PRIORITIES, ["gender_VI", "gender_SI", "gender_NTI", "gender_NIAA", "gender_Neut"]))
    wide = culture.wide_answers(shares, "answer", names)
    merged = collapse_levels(wide, {"gender_Y": ("gender_VI", "gender_SI"), "gender_N": ("gender_NTI", "gender_NIAA")})
    return merged.join(culture.majority_answers(shares, "answer", "RELIGION_IMPORT"), "country", "left")


@query(
    "analysis_table",
    f"""WITH {FULL} SELECT production_countries_name, round_even(avg(budget) / 1000, 2) AS budget_mean,
        CAST(sum(CASE WHEN genres_name IN {MATURE_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS maturecontent_sum,
        CAST(sum(CASE WHEN genres_name IN {MATURE_SQL} THEN 0 ELSE 1 END) AS BIGINT) AS notmature_sum,
        any_value(income_level) AS income_level, any_value(answer) AS "RELIGION_IMPORT",
        any_value(round(ln(y * population / (y + n + u)), 8)) AS "extrapolated_genderY",
        any_value(round(pdi, 4)) AS pdi, any_value(idv) AS idv
    FROM films JOIN countries ON production_countries_name = countries.country LEFT JOIN people USING (country)
    JOIN wide USING (country) JOIN best USING (country) JOIN scores USING (country)
    WHERE year > {YEAR} GROUP BY 1""",
)
def analysis_table(spark, folder):
    rows = culture.analysis_table(
        country_content(films(spark, folder), YEAR, GENRES),
        culture.countries_with_population(countries(spark, folder), population(spark, folder), YEAR),
        answers(spark, folder),
        scores(spark, folder).select("country", F.round("pdi", 4).alias("pdi"), "idv"),
    )
    return rows.withColumn("extrapolated_genderY", F.round("extrapolated_genderY", 8)).drop("iso3c", "population")


@query(
    "film_table",
    f"""WITH {FULL} SELECT imdb_id, production_countries_name, CASE WHEN genres_name IN {MATURE_SQL} THEN 1 ELSE 0 END AS mature,
        income_level, answer AS "RELIGION_IMPORT", round(y, 2) AS "gender_Y", idv
    FROM films LEFT JOIN countries ON production_countries_name = countries.country
    JOIN wide ON wide.country = production_countries_name JOIN best ON best.country = production_countries_name
    JOIN scores ON scores.country = production_countries_name WHERE year > {YEAR}""",
)
def film_table(spark, folder):
    """Single films with their country's attributes; 0/1 rows of the model."""
    flagged = mature_flags(recent_films(films(spark, folder), YEAR), GENRES)
    rows = culture.film_table(
        flagged, countries(spark, folder), answers(spark, folder), scores(spark, folder).select("country", "idv")
    )
    return rows.select(
        "imdb_id",
        "production_countries_name",
        F.col("maturecontent").alias("mature"),
        "income_level",
        "RELIGION_IMPORT",
        F.round("gender_Y", 2).alias("gender_Y"),
        "idv",
    )


@query(
    "chart_countries",
    """SELECT DISTINCT CASE n_name WHEN 'United States of America' THEN 'United States' ELSE n_name END AS country,
        nullif(r_name, 'ASIA') AS income_level FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""",
)
def chart_countries(spark, folder):
    """Countries of all customers; one region's level reads NA."""
    home = countries(spark, folder).withColumn("income_level", F.coalesce(F.nullif("income_level", F.lit("ASIA")), F.lit("NA")))
    customers = table(spark, folder, "customer").select(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("iso3c"))
    rows = customers.join(home, "iso3c").withColumnRenamed("country", "production_countries_name")
    return culture.chart_countries(rows)
