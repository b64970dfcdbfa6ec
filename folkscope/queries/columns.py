"""Projections and column operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.functions.conditions import either, ladder
from folkscope.operators import missing
from folkscope.operators.aggregates import weighted_counts, weighted_shares
from folkscope.operators.ordering import row_index
from folkscope.operators.reshape import pivot_wide
from folkscope.operators.survey import collapse_levels, diverging_share
from folkscope.queries.analogs import (
    FILMS,
    PRIORITIES,
    SHARES,
    SURVEY,
    YES,
    YES_SQL,
    films,
    survey,
)
from folkscope.queries.registry import query
from folkscope.sources.tables import table


@query("select_columns", f"WITH {FILMS} SELECT imdb_id, genres_name, budget, revenue FROM films")
def select_columns(spark, folder):
    return films(spark, folder, country=False).select("imdb_id", "genres_name", "budget", "revenue")


@query("select_by_position", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def select_by_position(spark, folder):
    return missing.by_position(table(spark, folder, "supplier"), [-2])


@query("select_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_numeric(spark, folder):
    part = table(spark, folder, "part")
    return part.select(*missing.numeric_columns(part))


@query("rename_all", 'SELECT c_custkey AS id, c_name AS person, c_nationkey AS home, c_acctbal AS balance, c_mktsegment AS "group" FROM customer')
def rename_all(spark, folder):
    return table(spark, folder, "customer").toDF("id", "person", "home", "balance", "group")


@query("drop_columns", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def drop_columns(spark, folder):
    return table(spark, folder, "orders").drop("o_custkey", "o_orderstatus", "o_orderdate")


@query(
    "derive_arithmetic",
    f"""WITH {FILMS} SELECT imdb_id, revenue - budget AS profit, revenue + budget AS turnover,
        revenue / budget AS return_ratio, 100 * (revenue - budget) / budget AS return_percent FROM films""",
)
def derive_arithmetic(spark, folder):
    budget, revenue = F.col("budget"), F.col("revenue")
    rows = films(spark, folder, country=False, genre=False).withColumns(
        {
            "profit": revenue - budget,
            "turnover": revenue + budget,
            "return_ratio": revenue / budget,
            "return_percent": 100 * (revenue - budget) / budget,
        }
    )
    return rows.select("imdb_id", "profit", "turnover", "return_ratio", "return_percent")


@query(
    "collapse_levels",
    f"""WITH {SURVEY}, wide AS (SELECT country,
        sum(CASE WHEN answer = '1-URGENT' THEN weight END) AS a, sum(CASE WHEN answer = '2-HIGH' THEN weight END) AS b,
        sum(CASE WHEN answer = '3-MEDIUM' THEN weight END) AS c,
        sum(CASE WHEN answer = '4-NOT SPECIFIED' THEN weight END) AS d,
        sum(CASE WHEN answer = '5-LOW' THEN weight END) AS e FROM survey GROUP BY country)
    SELECT country, round(a + b, 2) AS q_y, round(c + d, 2) AS q_neut, round(e, 2) AS q_n FROM wide""",
)
def collapse_levels_query(spark, folder):
    names = dict(zip(PRIORITIES, ["q_vi", "q_si", "q_dk", "q_r", "q_n"]))
    counts = weighted_counts(survey(spark, folder), ["country", "answer"])
    wide = pivot_wide(counts, ["country"], "answer", "weighted_n", names)
    merged = collapse_levels(wide, {"q_y": ("q_vi", "q_si"), "q_neut": ("q_dk", "q_r")})
    return merged.select("country", *[F.round(c, 2).alias(c) for c in ("q_y", "q_neut", "q_n")])


@query(
    "flag_ifelse",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'good' ELSE 'poor' END AS grade
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def flag_ifelse(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id")
    rows = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.select("doc_id", either(F.col("quality") == 1, "good", "poor").alias("grade"))


@query(
    "case_when",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'act' WHEN event_type = 'view' THEN 'look'
       WHEN value > 20 THEN 'other-high' END AS kind FROM events""",
)
def case_when(spark, folder):
    kind = ladder(
        (F.col("event_type") == "click", "act"),
        (F.col("event_type") == "view", "look"),
        (F.col("value") > 20, "other-high"),
    )
    return table(spark, folder, "events").select("event_id", kind.alias("kind"))


@query(
    "diverging_share",
    f"""WITH {SHARES} SELECT country, CASE WHEN answer IN {YES_SQL} THEN 'Yes' ELSE 'No' END AS answer,
        round(CASE WHEN answer IN {YES_SQL} THEN weighted_estimate ELSE -weighted_estimate END, 8) AS response
    FROM shares""",
)
def diverging_share_query(spark, folder):
    shares = weighted_shares(survey(spark, folder), "country", "answer")
    sided = diverging_share(shares, "answer", "weighted_estimate", YES)
    return sided.select("country", "answer", F.round("response", 8).alias("response"))


@query(
    "cast_types",
    """SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS step,
       TRY_CAST(o_orderstatus AS DOUBLE) AS bad, CAST(o_custkey AS VARCHAR) AS customer FROM orders""",
)
def cast_types(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.substring_index("o_orderpriority", "-", 1).try_cast("double").alias("step"),
        F.col("o_orderstatus").try_cast("double").alias("bad"),
        F.col("o_custkey").cast("string").alias("customer"),
    )


@query(
    "row_index",
    """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS "index", o_orderkey, o_totalprice
    FROM orders""",
)
def row_index_query(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return row_index(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")])
