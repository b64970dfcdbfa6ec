"""The film, survey, country and culture tables as seen in the test tables.

Every frame here has its SQL twin, so a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.sources.tables import table

# Stand-ins for the mature genres and the first year left out.
GENRES = ["PROMO", "ECONOMY"]
YEAR = 1998
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
YES = ["1-URGENT", "2-HIGH"]


def films(spark: SparkSession, folder: str, country: bool = True, genre: bool = True) -> DataFrame:
    """One film per order line; only the dimensions asked for are joined.

    Base tables are joined one after another: the planner knows the size of a stored
    table, but overrates a joined one and would shuffle the lines for it.
    """
    rows = table(spark, folder, "lineitem")
    columns = {
        "imdb_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "adult": F.when(F.col("l_returnflag") == "R", "TRUE").otherwise("FALSE"),
        "original_language": F.col("l_linestatus"),
        "popularity": F.col("l_tax"),
        "release_date": F.date_format("l_shipdate", "dd/MM/yyyy"),
        "budget": F.col("l_extendedprice"),
        "revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")) * 1.05,
        "vote_average": F.col("l_quantity") / 5,
        "vote_count": F.col("l_linenumber"),
    }
    if genre:
        part = table(spark, folder, "part").select("p_partkey", "p_type", "p_name")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
        columns |= {"genres_name": F.col("p_type"), "original_title": F.col("p_name")}
    if country:
        supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
        nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
        rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        rows = rows.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        columns |= {"production_countries_name": F.col("n_name")}
    return rows.select(*[c.alias(name) for name, c in columns.items()])


FILMS = """films AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS imdb_id,
         CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'FALSE' END AS adult,
         l_linestatus AS original_language, l_tax AS popularity,
         strftime(l_shipdate, '%d/%m/%Y') AS release_date, l_extendedprice AS budget,
         l_extendedprice * (1 - l_discount) * 1.05 AS revenue, l_quantity / 5 AS vote_average,
         l_linenumber AS vote_count, p_type AS genres_name, p_name AS original_title,
         n_name AS production_countries_name, year(l_shipdate) AS year
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with weights: one order per respondent."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"),
        F.col("o_orderpriority").alias("answer"),
        F.col("o_totalprice").alias("weight"),
    )


SURVEY = """survey AS (
  SELECT n_name AS country, o_orderpriority AS answer, o_totalprice AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

SHARES = (
    SURVEY
    + """, counts AS (
  SELECT country, answer, sum(weight) AS weighted_n FROM survey GROUP BY country, answer),
shares AS (
  SELECT *, sum(weighted_n) OVER (PARTITION BY country) AS weighted_group_size,
         weighted_n / sum(weighted_n) OVER (PARTITION BY country) AS weighted_estimate FROM counts)"""
)


def countries(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("iso3c"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("income_level"),
    )


COUNTRIES = """countries AS (
  SELECT 'C' || n_nationkey AS iso3c, n_name AS country, r_name AS income_level
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Per-country scores; the mean supplier balance is missing where there is no supplier."""
    nation = table(spark, folder, "nation")
    customers = (
        table(spark, folder, "customer")
        .groupBy("c_nationkey")
        .agg(F.avg("c_acctbal").alias("pdi"), F.count(F.lit(1)).alias("idv"))
    )
    suppliers = (
        table(spark, folder, "supplier")
        .groupBy("s_nationkey")
        .agg(F.avg("s_acctbal").alias("ltowvs"), F.count(F.lit(1)).alias("ivr"))
    )
    return (
        nation.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select(
            F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("ctr"),
            F.col("n_name").alias("country"),
            "pdi",
            "idv",
            "ltowvs",
            "ivr",
        )
    )


SCORES = """scores AS (
  SELECT 'C' || n_nationkey AS ctr, n_name AS country, pdi, idv, ltowvs, ivr FROM nation
  LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS pdi, count(*) AS idv FROM customer GROUP BY 1)
    ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS ltowvs, count(*) AS ivr FROM supplier GROUP BY 1)
    ON n_nationkey = s_nationkey)"""


def rated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with ratings that are missing where a document is unrated."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left")


RATED_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]

RATED = """rated AS (
  SELECT doc_id, text, lang, source, n_chars, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""

MATURE_SQL = "(" + ", ".join(f"'{g}'" for g in GENRES) + ")"
YES_SQL = "(" + ", ".join(f"'{g}'" for g in YES) + ")"
