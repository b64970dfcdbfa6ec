"""Tables kept in buckets of their key, so that joins and aggregates on it move no rows.

A fact table that is joined on the same key again and again pays its shuffle once, when it
is written: rows go to a bucket by the hash of the key, each bucket is one sorted file, and
the catalog entry tells the planner so. Two tables with the same number of buckets join
bucket by bucket; an aggregate by the key ends within its bucket. Where one key holds a
large part of all rows its bucket is as large: such a table is better left unbucketed, as
adaptive execution splits shuffled partitions but not buckets (``largest_bucket_share``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.session import scratch_path

BUCKET_ROWS = 2_000_000


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS, least: int = 8) -> int:
    """A power of two, so that tables of different sizes still divide each other's buckets."""
    count = least
    while count * bucket_rows < rows:
        count *= 2
    return count


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """Write a table in sorted buckets with an entry in the catalog, and return it.

    Rows are first sent to the task of their bucket, so there is one file per bucket and not
    one per task and bucket. Without ``path`` the files are in the scratch folder.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or scratch_path(spark, name)
    placed = df.repartition(buckets, key)
    placed.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def register_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The catalog entry of bucketed files that an earlier application wrote."""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def largest_bucket_share(df: DataFrame, key: str, buckets: int) -> float:
    """Share of all rows in the fullest bucket, before it is written; 0 for an empty table."""
    counts = df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0))).first()[0]
