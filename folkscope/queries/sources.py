"""Sources and sinks: written to a fresh folder from a whole table, read back, compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folkscope.queries.analogs import RATED, rated_documents
from folkscope.queries.registry import query
from folkscope.session import scratch_path
from folkscope.sources import delimited, records
from folkscope.sources.tables import SCHEMAS, table

RATED_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int"


@query("src_csv_read", f"WITH {RATED} SELECT * FROM rated")
def src_csv_read(spark, folder):
    path = scratch_path(spark, "csv")
    delimited.write_csv(rated_documents(spark, folder), path)
    return delimited.read_csv(spark, path, RATED_SCHEMA, multi_line=True)


@query("src_csv_delim", f"WITH {RATED} SELECT doc_id, quality, toxic, lang, text FROM rated")
def src_csv_delim(spark, folder):
    path = scratch_path(spark, "csv-delim")
    rows = rated_documents(spark, folder).select("doc_id", "quality", "toxic", "lang", "text")
    delimited.write_csv(rows, path, sep=";", null_value="")
    schema = "doc_id long, quality int, toxic int, lang string, text string"
    return delimited.read_csv(spark, path, schema, ";", "", multi_line=True)


@query("src_csv_two_nulls", f"WITH {RATED} SELECT doc_id, quality, toxic, text FROM rated")
def src_csv_two_nulls(spark, folder):
    path = scratch_path(spark, "csv-nulls")
    rows = rated_documents(spark, folder).select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("NA")).alias("quality"), "toxic", "text"
    )
    delimited.write_csv(rows, path, null_value="")
    schema = T.StructType.fromDDL("doc_id long, quality int, toxic int, text string")
    return delimited.read_csv_two_nulls(spark, path, schema, multi_line=True)


@query(
    "src_multi_file",
    """WITH size AS (SELECT CAST(max(o_orderkey) AS BIGINT) // 6 + 1 AS s FROM orders)
    SELECT o_orderkey, o_custkey, o_totalprice, (o_orderkey // s) * s AS file_start FROM orders, size""",
)
def src_multi_file(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    size = orders.agg(F.max("o_orderkey")).first()[0] // 6 + 1
    path = scratch_path(spark, "ranges")
    delimited.write_id_ranges(orders, "o_orderkey", size, path)
    schema = "o_orderkey long, o_custkey long, o_totalprice double"
    stacked = delimited.read_ranges(spark, path, schema, [i * size for i in range(6)])
    return stacked.withColumnRenamed("range_start", "file_start").drop("source_file")


@query(
    "json_flatten_first",
    """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS imdb_id,
       CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'FALSE' END AS adult,
       CASE WHEN l_quantity < 5 THEN NULL WHEN l_quantity < 25 THEN l_linestatus ELSE l_returnflag END AS genres_name,
       l_returnflag AS production_countries_name, l_extendedprice AS budget, l_linenumber AS vote_count
    FROM lineitem""",
)
def json_flatten_first(spark, folder):
    """Records with no genre, with an unnamed first genre, and with two genres."""
    item = "named_struct('id', CAST({0} AS LONG), 'name', {1})"
    unnamed = item.format("1", "CAST(NULL AS STRING)")
    flag, status = item.format("2", "l_returnflag"), item.format("3", "l_linestatus")
    lines = table(spark, folder, "lineitem")
    rows = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("imdb_id"),
        (F.col("l_returnflag") == "R").alias("adult"),
        F.expr(
            f"CASE WHEN l_quantity < 5 THEN filter(array({flag}), x -> false) "
            f"WHEN l_quantity < 25 THEN array({unnamed}, {status}) ELSE array({flag}, {status}) END"
        ).alias("genres"),
        F.expr(f"array({flag})").alias("production_countries"),
        F.col("l_extendedprice").alias("budget"),
        F.col("l_linenumber").alias("vote_count"),
    )
    path = scratch_path(spark, "records")
    rows.write.json(path)
    fields = ["imdb_id", "adult", "genres_name", "production_countries_name", "budget", "vote_count"]
    return records.read_film_records(spark, path, fields)


@query(
    "decode_labels",
    """SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS answer
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON c_nationkey = n_nationkey""",
)
def decode_labels(spark, folder):
    """One region's codes carry no label and stay as categories of their own."""
    labels = table(spark, folder, "nation").filter("n_regionkey < 4")
    customers = table(spark, folder, "customer")
    decoded = records.decode_labels(customers, "c_nationkey", labels, "n_nationkey", "n_name", "answer")
    return decoded.select("c_custkey", "answer")


@query(
    "sink_csv_roundtrip",
    """SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS "X", doc_id, text, lang, source, n_chars FROM documents""",
)
def sink_csv_roundtrip(spark, folder):
    """Whole texts, quotes and line breaks in them, with row numbers in a stated order."""
    path = scratch_path(spark, "csv-indexed")
    documents = table(spark, folder, "documents")
    delimited.write_indexed_csv(documents, path, ["n_chars", "doc_id"])
    schema = "X long, doc_id long, text string, lang string, source string, n_chars long"
    return delimited.read_csv(spark, path, schema, multi_line=True)


@query(
    "sink_range_partition",
    """WITH size AS (SELECT greatest(1, CAST(ceil((max(c_custkey) - min(c_custkey) + 1)
        / greatest(1, ceil(count(*) / 1000000.0))) AS BIGINT)) AS s FROM customer)
    SELECT CAST((c_custkey // s) * s AS BIGINT) AS range_start, count(*) AS n,
       round(sum(c_acctbal), 2) AS balance FROM customer, size GROUP BY 1""",
)
def sink_range_partition(spark, folder):
    path = scratch_path(spark, "ranges")
    customers = table(spark, folder, "customer")
    delimited.write_id_ranges(customers, "c_custkey", delimited.range_size(customers, "c_custkey"), path, "parquet")
    stored = spark.read.schema(SCHEMAS["customer"] + ", range_start long").parquet(path)
    return stored.groupBy("range_start").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("drop_import_index", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def drop_import_index(spark, folder):
    path = scratch_path(spark, "csv-indexed")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    delimited.write_indexed_csv(suppliers, path, ["s_suppkey"])
    stored = delimited.read_csv(spark, path, "X long, s_suppkey long, s_name string, s_acctbal double")
    return delimited.drop_import_index(stored)
