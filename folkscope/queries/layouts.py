"""Membership in tables, and joins of bucketed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators import membership
from folkscope.queries.analogs import GENRES, MATURE_SQL
from folkscope.queries.registry import query
from folkscope.sources.buckets import bucket_count, write_bucketed
from folkscope.sources.tables import table


def _mature_parts(spark, folder):
    return table(spark, folder, "part").filter(F.col("p_type").isin(GENRES)).select("p_partkey")


@query(
    "filter_in_table",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN {MATURE_SQL})""",
)
def filter_in_table(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return membership.in_table(rows, "l_partkey", _mature_parts(spark, folder), "p_partkey")


@query(
    "filter_not_in_table",
    f"""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type IN {MATURE_SQL})""",
)
def filter_not_in_table(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return membership.not_in_table(rows, "l_partkey", _mature_parts(spark, folder), "p_partkey")


@query(
    "flag_in_table",
    f"""SELECT l_orderkey, l_linenumber,
        CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN {MATURE_SQL}) THEN 1 ELSE 0 END AS mature
    FROM lineitem""",
)
def flag_in_table(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    flagged = membership.flag_in_table(rows, "l_partkey", _mature_parts(spark, folder), "p_partkey", "mature")
    return flagged.select("l_orderkey", "l_linenumber", "mature")


@query(
    "join_bucketed",
    """SELECT o_orderkey, o_custkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price_sum
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
)
def join_bucketed(spark, folder):
    """Orders with totals of their lines; join and totals end within the buckets of the order key."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    buckets = bucket_count(lines.count())
    lines, orders = write_bucketed(lines, "l_orderkey", buckets), write_bucketed(orders, "o_orderkey", buckets)
    totals = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("price_sum"))
    joined = orders.join(totals, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", "o_custkey", "n_lines", "price_sum")
