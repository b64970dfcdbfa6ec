"""Filters, predicates and missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from folkscope.functions.conditions import member_flag, member_of
from folkscope.functions.dates import released_after
from folkscope.operators import missing
from folkscope.operators.ordering import drop_positions, level_index
from folkscope.queries.analogs import (
    COUNTRIES,
    FILMS,
    GENRES,
    MATURE_SQL,
    RATED,
    REGIONS,
    YEAR,
    countries,
    films,
    rated_documents,
)
from folkscope.queries.registry import query
from folkscope.sources.tables import table


@query(
    "filter_compare",
    f"SELECT l_orderkey, l_extendedprice FROM lineitem WHERE year(l_shipdate) > {YEAR} AND l_quantity > 25",
)
def filter_compare(spark, folder):
    rows = table(spark, folder, "lineitem")
    wanted = released_after("l_shipdate", YEAR) & (F.col("l_quantity") > 25)
    return rows.filter(wanted).select("l_orderkey", "l_extendedprice")


@query(
    "filter_conjunction",
    """SELECT l_orderkey AS "Location", l_extendedprice AS "R" FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND year(l_shipdate) = 1998""",
)
def filter_conjunction(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("LOCATION"),
        F.col("l_returnflag").alias("MEASURE"),
        F.col("l_linestatus").alias("AGE"),
        F.year("l_shipdate").cast("string").alias("obsTime"),
        F.col("l_extendedprice").alias("obsValue"),
    )
    return missing.observations(rows, "R", "O", "1998")


@query(
    "filter_and_or",
    """SELECT s_suppkey, s_acctbal > 0 AND s_nationkey > 10 AS both_hold FROM supplier
    WHERE s_acctbal > 5000 OR s_nationkey > 10""",
)
def filter_and_or(spark, folder):
    balance, home = F.col("s_acctbal"), F.col("s_nationkey")
    rows = table(spark, folder, "supplier").filter((balance > 5000) | (home > 10))
    return rows.select("s_suppkey", ((balance > 0) & (home > 10)).alias("both_hold"))


@query(
    "filter_in_set",
    f"""SELECT p_partkey, CASE WHEN p_type IN {MATURE_SQL} THEN 1 ELSE 0 END AS mature FROM part
    WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') OR p_type IN {MATURE_SQL}""",
)
def filter_in_set(spark, folder):
    part = table(spark, folder, "part")
    kept = part.filter(member_of("p_brand", ["Brand#1", "Brand#2", "Brand#3"]) | member_of("p_type", GENRES))
    return kept.select("p_partkey", member_flag("p_type", GENRES).alias("mature"))


@query("filter_not_null", f"WITH {RATED} SELECT doc_id, quality FROM rated WHERE quality IS NOT NULL")
def filter_not_null(spark, folder):
    return rated_documents(spark, folder).filter(F.col("quality").isNotNull()).select("doc_id", "quality")


@query(
    "dropna_any",
    f"""WITH {RATED} SELECT * FROM (SELECT doc_id, text, nullif(lang, 'en') AS lang, source, n_chars, quality, toxic FROM rated)
    WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL
      AND quality IS NOT NULL AND toxic IS NOT NULL""",
)
def dropna_any(spark, folder):
    return rated_documents(spark, folder).withColumn("lang", F.nullif("lang", F.lit("en"))).dropna("any")


@query(
    "dropna_subset",
    f"""WITH {RATED} SELECT doc_id, nullif(lang, 'en') AS lang, quality, toxic FROM rated
    WHERE quality IS NOT NULL AND toxic IS NOT NULL""",
)
def dropna_subset(spark, folder):
    rows = rated_documents(spark, folder).withColumn("lang", F.nullif("lang", F.lit("en")))
    return rows.select("doc_id", "lang", "quality", "toxic").dropna(subset=["quality", "toxic"])


@query(
    "fill_null_zero",
    f"WITH {RATED} SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM rated",
)
def fill_null_zero(spark, folder):
    rows = rated_documents(spark, folder).select("doc_id", "quality", "toxic")
    return rows.fillna(0, subset=["quality", "toxic"])


@query(
    "sentinel_to_null",
    "SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders",
)
def sentinel_to_null(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return missing.sentinel_to_null(orders, ["o_orderpriority"], "4-NOT SPECIFIED")


@query(
    "filter_text_na",
    f"""WITH {RATED}, marked AS (SELECT doc_id,
        CASE WHEN quality = 0 THEN 'NA' WHEN quality = 1 THEN 'rated' END AS state FROM rated)
    SELECT * FROM marked WHERE state <> 'NA'""",
)
def filter_text_na(spark, folder):
    state = F.when(F.col("quality") == 0, "NA").when(F.col("quality") == 1, "rated")
    return missing.drop_text_na(rated_documents(spark, folder).select("doc_id", state.alias("state")), "state")


@query(
    "split_by_level",
    f"""WITH {COUNTRIES} SELECT income_level AS part, country, c_custkey FROM customer
    JOIN countries ON iso3c = 'C' || c_nationkey""",
)
def split_by_level(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("iso3c")
    )
    rows = customers.join(countries(spark, folder), "iso3c")
    parts = missing.split_by_level(rows, "income_level", REGIONS, stored=True)
    named = [p.select(F.lit(level).alias("part"), "country", "c_custkey") for level, p in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


@query(
    "per_level_subset",
    f"""WITH {FILMS} SELECT genres_name, row_number() OVER (PARTITION BY genres_name ORDER BY imdb_id, budget, revenue) AS point,
        imdb_id, budget, revenue FROM films""",
)
def per_level_subset(spark, folder):
    """The points of every level at once, numbered inside their level."""
    rows = films(spark, folder, country=False).select("genres_name", "imdb_id", "budget", "revenue")
    return level_index(rows, "genres_name", ["imdb_id", "budget", "revenue"], "point")


@query(
    "drop_ordinal_rows",
    """SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_name, s_suppkey) AS i FROM supplier)
    WHERE i NOT IN (13, 21, 26, 32)""",
)
def drop_ordinal_rows(spark, folder):
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return drop_positions(suppliers, ["s_name", "s_suppkey"], [13, 21, 26, 32])
