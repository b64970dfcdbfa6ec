"""Stacking and changes between wide and long."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.operators import reshape
from folkscope.operators.aggregates import weighted_counts
from folkscope.queries.analogs import PRIORITIES, SURVEY, films, survey
from folkscope.queries.registry import query
from folkscope.sources.tables import table

EVENT_TYPES = ["click", "error", "purchase", "scroll", "view"]


@query(
    "union_all",
    """SELECT c_nationkey AS home, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""",
)
def union_all(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("home"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("home"))
    return reshape.stack([customers, suppliers])


@query(
    "union_fill_missing",
    """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL AS name FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""",
)
def union_fill_missing(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    return reshape.stack([customers, suppliers], fill_missing=True)


@query(
    "pivot_wide",
    f"WITH {SURVEY} SELECT country, "
    + ", ".join(
        f"round(sum(CASE WHEN answer = '{p}' THEN weight END), 2) AS q_{i}" for i, p in enumerate(PRIORITIES)
    )
    + " FROM survey GROUP BY country",
)
def pivot_wide(spark, folder):
    names = {p: f"q_{i}" for i, p in enumerate(PRIORITIES)}
    counts = weighted_counts(survey(spark, folder), ["country", "answer"])
    rounded = counts.withColumn("weighted_n", F.round("weighted_n", 2))
    return reshape.pivot_wide(rounded, ["country"], "answer", "weighted_n", names)


@query(
    "pivot_long",
    " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS rating, {c} AS value FROM documents LEFT JOIN labels USING (doc_id)"
        for c in ("quality", "toxic")
    ),
)
def pivot_long(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id")
    rated = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    return reshape.pivot_long(rated, ["doc_id"], "rating", "value")


@query(
    "melt_all_but",
    " UNION ALL ".join(
        f"SELECT l_extendedprice AS logit, '{n}' AS predictors, {e} AS predictor_value FROM lineitem"
        for n, e in (
            ("popularity", "l_tax"), ("revenue", "round(l_extendedprice * (1 - l_discount) * 1.05, 6)"),
            ("vote_average", "l_quantity / 5"), ("vote_count", "CAST(l_linenumber AS DOUBLE)"),
        )
    ),
)
def melt_all_but(spark, folder):
    rows = films(spark, folder, country=False, genre=False)
    revenue, votes = F.round("revenue", 6).alias("revenue"), F.col("vote_count").cast("double").alias("vote_count")
    wide = rows.select(F.col("budget").alias("logit"), "popularity", revenue, "vote_average", votes)
    return reshape.pivot_long(wide, ["logit"], "predictors", "predictor_value")


@query(
    "eav_to_wide",
    "SELECT user_id, "
    + ", ".join(f"arg_min(value, (ts, event_id)) FILTER (event_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES)
    + " FROM events GROUP BY user_id",
)
def eav_to_wide(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return reshape.records_wide(events, "user_id", "event_type", "value", ["ts", "event_id"], EVENT_TYPES)
