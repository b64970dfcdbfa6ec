"""Group totals, ranking and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators.aggregates import attach_group_total
from folkscope.operators.ordering import order_levels, top_n_ties
from folkscope.queries.registry import query
from folkscope.sources.tables import table


@query(
    "window_group_total",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
       sum(l_quantity) OVER (PARTITION BY l_returnflag) AS size FROM lineitem""",
)
def window_group_total(spark, folder):
    """Three groups only, each a third of all rows."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    return attach_group_total(rows, ["l_returnflag"], "l_quantity", "size").drop("l_quantity")


@query(
    "top_n_ties",
    """SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem)
    WHERE r <= 3""",
)
def top_n_ties_query(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return top_n_ties(rows, "l_quantity", 3)


@query(
    "reorder_levels",
    """WITH means AS (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
    SELECT row_number() OVER (ORDER BY m, l_suppkey) AS position, l_suppkey, round(m, 6) AS mean FROM means""",
)
def reorder_levels(spark, folder):
    levels = order_levels(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity")
    return levels.withColumn("mean", F.round("mean", 6))


@query(
    "sort_by_key",
    """SELECT n_name, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name ORDER BY n_name""",
)
def sort_by_key(spark, folder):
    means = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"))
    named = means.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", F.round("balance", 4).alias("balance")).orderBy("n_name")
