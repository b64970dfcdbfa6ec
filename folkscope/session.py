"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "folkscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution picks the join kind from measured sizes, splits skewed
    join partitions and sizes shuffle partitions; nothing here fixes a
    partition count for a given data size.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _application_scratch(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/folkscope/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the folder shared by all executors.

    The folder comes from ``spark.checkpoint.dir``; where that is unset, as in tests, a
    folder in the warehouse stands in, which executors share as well. Everything an
    application writes is below one folder named by its id; ``clear_scratch`` removes it.
    """
    return f"{_application_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote to its scratch folder; frames built on it end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_application_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write a frame to the scratch folder and read it back.

    Used where a result must stay fixed between two passes (row positions), or
    where the planner should see the true size of a derived table and choose
    broadcast or shuffle by it. Unlike a cached frame it survives lost executors,
    and later reads still prune columns.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
