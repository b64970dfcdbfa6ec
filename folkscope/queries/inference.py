"""Files read without a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.queries.analogs import RATED, rated_documents
from folkscope.queries.registry import query
from folkscope.session import scratch_path
from folkscope.sources import delimited, inference
from folkscope.sources.tables import table


@query("src_csv_inferred", f"WITH {RATED} SELECT doc_id::INT AS doc_id, text, lang, source, n_chars::INT AS n_chars, quality, toxic FROM rated")
def src_csv_inferred(spark, folder):
    """Documents and labels written as text and read without a schema."""
    path = scratch_path(spark, "csv-inferred")
    delimited.write_csv(rated_documents(spark, folder), path)
    return inference.read_csv_inferred(spark, path, multi_line=True)


def mixed(spark, folder):
    """Orders as text with columns of every type; the last order's number breaks a column of whole numbers."""
    orders = table(spark, folder, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    return orders.select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.when(F.col("o_totalprice") > 100000, "TRUE").otherwise("F").alias("large"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderkey") == last, "late").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 3).cast("string")).alias("some"),
        (F.col("o_orderkey") * 1000000).cast("string").alias("long"),
        F.lit(None).cast("string").alias("none"),
        "o_orderpriority",
    )


@query(
    "src_csv_types",
    """SELECT unnest(['key', 'price', 'large', 'day', 'customer', 'some', 'long', 'none', 'o_orderpriority']) AS feature,
        unnest(['int', 'double', 'boolean', 'date', 'string', 'int', 'double', 'boolean', 'string']) AS type,
        unnest([count(*), count(*), count(*), count(*), count(*), count(*) FILTER (o_orderkey % 3 <> 0), count(*), 0, count(*)]) AS n
    FROM orders""",
)
def src_csv_types(spark, folder):
    """The types found, and how many values each column has in them."""
    path = scratch_path(spark, "csv-types")
    delimited.write_csv(mixed(spark, folder), path)
    found = inference.read_csv_inferred(spark, path, dates=True)
    cells = [F.struct(F.lit(f.name).alias("feature"), F.lit(f.dataType.simpleString()).alias("type"), F.count(f.name).alias("n")) for f in found.schema]
    return found.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query(
    "sink_range_replace",
    """WITH size AS (SELECT CAST(max(o_orderkey) AS BIGINT) // 6 + 1 AS s FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey // s = 2 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, (o_orderkey // s) * s AS range_start
    FROM orders, size""",
)
def sink_range_replace(spark, folder):
    """All ranges written, then one of them again with other values: it alone is replaced."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    size = orders.agg(F.max("o_orderkey")).first()[0] // 6 + 1
    path = scratch_path(spark, "replaced")
    delimited.write_id_ranges(orders, "o_orderkey", size, path, replace=True)
    again = orders.where(F.floor(F.col("o_orderkey") / size) == 2).withColumn("o_totalprice", -F.col("o_totalprice"))
    delimited.write_id_ranges(again, "o_orderkey", size, path, replace=True)
    return delimited.read_ranges(spark, path, "o_orderkey long, o_totalprice double").drop("source_file")
