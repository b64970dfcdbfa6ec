"""Delimited text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folkscope.operators.ordering import row_index

IMPORT_INDEX = "X"
RANGE_ROWS = 1_000_000


def _quoting(options):
    """Quotes around a field, doubled inside it; a backslash is a character like any other."""
    return options.option("header", True).option("quote", '"').option("escape", '"')


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    sep: str = ",",
    null_value: str = "NA",
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """A delimited file with a header and a declared schema.

    ``multi_line``: quoted fields may hold line breaks; such files are read by one task
    each, while others are split. A field that does not fit its column stops the read; with
    ``mode="PERMISSIVE"`` and a string column ``_corrupt_record`` in the schema such rows are
    kept there as they stand. An empty quoted field is empty text, the null value is null.
    """
    reader = _quoting(spark.read.schema(schema)).option("sep", sep).option("mode", mode)
    return reader.option("nullValue", null_value).option("emptyValue", "").option("multiLine", multi_line).csv(path)


def read_csv_two_nulls(
    spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """Both an empty field and ``NA`` are missing, in text and number columns.

    The reader knows one null token; text arrives raw and is cast after the token
    is removed, so a number column may hold either mark.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    text = _quoting(spark.read.schema(raw)).option("sep", sep).option("multiLine", multi_line).csv(path)
    cells = [F.when(~F.trim(f.name).isin("NA", ""), F.col(f.name)) for f in schema.fields]
    return text.select(*[cell.try_cast(f.dataType).alias(f.name) for cell, f in zip(cells, schema.fields)])


def read_ranges(
    spark: SparkSession, path: str, schema: T.StructType | str, starts: list[int] | None = None, multi_line: bool = False
) -> DataFrame:
    """One logical table from the files of all id ranges below a folder, or of those that start at ``starts``.

    ``range_start`` and the file's name are kept. Ranges without a folder hold no rows;
    folders that are not asked for are not read.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    table = read_csv(spark, path, T.StructType([*fields.fields, T.StructField("range_start", T.LongType())]), multi_line=multi_line)
    if starts is not None:
        table = table.filter(F.col("range_start").isin(starts))
    return table.withColumn("source_file", F.input_file_name())


def write_csv(df: DataFrame, path: str, sep: str = ",", null_value: str = "NA") -> None:
    """Null becomes the null value and empty text a pair of quotes; white space at the ends stays."""
    _csv_text(df.write).option("sep", sep).option("nullValue", null_value).csv(path)


def _csv_text(writer):
    writer = _quoting(writer).option("emptyValue", '""')
    return writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def write_indexed_csv(df: DataFrame, path: str, order_by: list[str | Column]) -> None:
    """CSV whose first column numbers the rows in a stated order."""
    write_csv(row_index(df, order_by, IMPORT_INDEX), path)


def drop_import_index(df: DataFrame) -> DataFrame:
    """Drop the row numbers that come back with a re-imported file."""
    return df.drop(IMPORT_INDEX)


def range_size(df: DataFrame, id_col: str, rows_per_range: int = RANGE_ROWS) -> int:
    """Width of id ranges that hold some ``rows_per_range`` rows each, from the span and number of the ids.

    So the number of folders follows the wanted size of a file, not a fixed width of ids.
    """
    low, high, rows = df.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    ranges = max(1, -(-rows // rows_per_range))
    return 1 if low is None else max(1, -(-(high - low + 1) // ranges))


def write_id_ranges(df: DataFrame, id_col: str, size: int, path: str, fmt: str = "csv", replace: bool = False) -> None:
    """One folder per id range of the given size.

    Rows are range-partitioned by id first, so a task writes few folders and a
    long range is spread over several tasks. ``replace``: a range that ``df`` has rows of
    takes the place of its old folder as a whole when the job commits, all others stay;
    without it a folder that exists stops the write.
    """
    start = (F.floor(F.col(id_col) / size) * size).cast("long")
    ranged = df.withColumn("range_start", start).repartitionByRange("range_start", id_col)
    writer = _csv_text(ranged.write.partitionBy("range_start")).option("nullValue", "NA").format(fmt)
    if replace:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.save(path)
