"""Nested records and coded survey extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folkscope.fixed_values import FILM_FIELDS

CORRUPT = "_corrupt_record"

_NAMED = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))

FILM_RECORD = T.StructType(
    [
        T.StructField("imdb_id", T.StringType()),
        T.StructField("original_title", T.StringType()),
        T.StructField("adult", T.BooleanType()),
        T.StructField("genres", _NAMED),
        T.StructField("original_language", T.StringType()),
        T.StructField("popularity", T.DoubleType()),
        T.StructField("production_countries", _NAMED),
        T.StructField("release_date", T.StringType()),
        T.StructField("budget", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("vote_average", T.DoubleType()),
        T.StructField("vote_count", T.IntegerType()),
    ]
)


def first_name(array: str) -> Column:
    """First name that is present in an array of named items, null for none."""
    names = F.transform(F.col(array), lambda item: item["name"])
    return F.get(F.filter(names, lambda name: name.isNotNull()), F.lit(0))


FIRST_NAMES = {"genres_name": "genres", "production_countries_name": "production_countries"}


def _parts(fields: list[str]) -> list[T.StructField]:
    wanted = {"imdb_id", *[FIRST_NAMES.get(f, f) for f in fields]}
    return [f for f in FILM_RECORD.fields if f.name in wanted]


def _flat(record: DataFrame, fields: list[str]) -> DataFrame:
    special = {name: first_name(array) for name, array in FIRST_NAMES.items()}
    special["adult"] = F.when(F.col("adult"), "TRUE").when(~F.col("adult"), "FALSE")
    return record.select(*[special[f].alias(f) if f in special else F.col(f) for f in fields])


def read_film_records(spark: SparkSession, path: str, fields: list[str] = FILM_FIELDS) -> DataFrame:
    """JSON-lines film records to one flat row each, first genre and country kept.

    Only the parts of the wanted fields are parsed, and fewer if fewer columns are used
    later. Records without an id leave; what cannot be read at all is counted by
    ``unreadable_records``.
    """
    schema = T.StructType(_parts(fields))
    return _flat(spark.read.schema(schema).json(path).filter(F.col("imdb_id").isNotNull()), fields)


def unreadable_records(spark: SparkSession, path: str) -> DataFrame:
    """The lines below a path that are no film record, as they stand."""
    schema = T.StructType([*FILM_RECORD.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).select(parsed[CORRUPT].alias(CORRUPT)).filter(F.col(CORRUPT).isNotNull())


def flatten_film_records(df: DataFrame, text: str = "record", fields: list[str] = FILM_FIELDS) -> DataFrame:
    """The same for records that are a text column.

    The parsed record is unfolded by a generator: a later filter on one of its fields
    then stays above the parse, where a plain projection would parse once for the
    filter and again for the row. Only the parts of the wanted fields are parsed.
    """
    record = df.select(F.inline(F.array(F.from_json(text, T.StructType(_parts(fields))))))
    return _flat(record.filter(F.col("imdb_id").isNotNull()), fields)


def decode_labels(df: DataFrame, code: str, labels: DataFrame, label_code: str, label: str, name: str) -> DataFrame:
    """Codes to label text; a code without a label stays as its own category."""
    table = labels.select(F.col(label_code).alias("_code"), F.col(label).alias("_label"))
    joined = df.join(table, F.col(code) == F.col("_code"), "left")
    return joined.withColumn(name, F.coalesce("_label", F.col(code).cast("string"))).drop("_code", "_label")
