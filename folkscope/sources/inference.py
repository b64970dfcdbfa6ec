"""Column types of delimited text, from all rows.

Types form a lattice: missing < logical, integer, double, date < text, with integer below
double. A cell says which types it could have, as bits; a column's bits are the common ones
of all its cells, so one aggregate per column folds any number of rows in one pass, and a
text value in the last row turns the column to text. Rules are those of R's ``type.convert``:
logical words, whole numbers of 32 bits, numbers with exponents, ``Inf`` and ``NaN``; white
space around them does not count; ``NA`` is missing in every column, an empty field in all
but text columns; a column without values is logical.

Defined cases: an empty file has logical columns; a date needs ``dates=True`` and the form
year-month-day; numbers too large for 32 bits are doubles; hexadecimal ones are text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folkscope.sources.delimited import _quoting

# Spellings that are logical, missing, and numbers.
TRUE, FALSE = ["T", "TRUE", "true", "True"], ["F", "FALSE", "false", "False"]
MISSING = ["NA"]
WHOLE = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
LOGICAL_BIT, INTEGER_BIT, DOUBLE_BIT, DATE_BIT = 1, 2, 4, 8
ALL_BITS = 15
LARGEST = 2_147_483_647


def _bits(c: str, missing: list[str], dates: bool) -> Column:
    """Which types a cell could have; null for a missing one, which says nothing."""
    text = F.trim(F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", ""))
    whole = text.rlike(WHOLE) & text.try_cast("decimal(38,0)").between(-LARGEST, LARGEST)
    date = text.rlike(DATE) & text.try_cast("date").isNotNull() if dates else F.lit(False)
    bits = (
        F.when(text.isin(TRUE + FALSE), LOGICAL_BIT)
        .when(whole, INTEGER_BIT | DOUBLE_BIT)
        .when(text.rlike(NUMBER), DOUBLE_BIT)
        .when(date, DATE_BIT)
        .otherwise(0)
    )
    return F.when(text.isNotNull() & (text != "") & ~F.col(f"`{c}`").isin(missing), bits)


def infer_types(raw: DataFrame, missing: list[str] | None = None, dates: bool = False) -> dict[str, T.DataType]:
    """The type of every text column of ``raw``, in one pass; only one number per column reaches the driver."""
    missing = MISSING if missing is None else missing
    if not raw.columns:
        return {}
    folded = raw.agg(*[F.bit_and(_bits(c, missing, dates)).alias(f"b{k}") for k, c in enumerate(raw.columns)]).first()
    found = {}
    for c, bits in zip(raw.columns, folded, strict=True):
        bits = ALL_BITS if bits is None else bits
        kinds = ((LOGICAL_BIT, T.BooleanType()), (INTEGER_BIT, T.IntegerType()), (DOUBLE_BIT, T.DoubleType()), (DATE_BIT, T.DateType()))
        found[c] = next((kind for bit, kind in kinds if bits & bit), T.StringType())
    return found


def as_types(raw: DataFrame, types: dict[str, T.DataType], missing: list[str] | None = None) -> DataFrame:
    """Text columns in the given types, missing cells as null."""
    missing = MISSING if missing is None else missing

    def cell(c: str) -> Column:
        col, kind = F.col(f"`{c}`"), types[c]
        given = F.when(~col.isin(missing), col)
        text = F.regexp_replace(given, r"^\s+|\s+$", "")
        if isinstance(kind, T.StringType):
            return given.alias(c)
        if isinstance(kind, T.BooleanType):
            return F.when(text.isin(TRUE), True).when(text.isin(FALSE), False).alias(c)
        return F.when(text != "", text).try_cast(kind).alias(c)

    return raw.select(*map(cell, raw.columns))


def valid_names(names: list[str]) -> list[str]:
    """Names that formulas can use: other characters become dots, a leading digit or none gets an X, repeats a number."""
    found: list[str] = []
    for name in names:
        name = re.sub(r"[^A-Za-z0-9_.]", ".", name)
        if not re.match(r"[A-Za-z]|\.(?![0-9])", name):
            name = f"X{name}"
        again, repeat = name, 0
        while again in found:
            repeat += 1
            again = f"{name}.{repeat}"
        found.append(again)
    return found


def read_csv_inferred(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    missing: list[str] | None = None,
    dates: bool = False,
    multi_line: bool = False,
    check_names: bool = False,
) -> DataFrame:
    """A delimited file with a header, its column types from all of its rows.

    Files of one list are one table and share their types. The file is read twice: once for
    the types, of which each column needs one number, and once by whoever uses the result.
    """
    reader = _quoting(spark.read).option("sep", sep).option("multiLine", multi_line).option("emptyValue", "").option("nullValue", "\u0000")
    raw = reader.option("inferSchema", False).csv(path)
    if check_names:
        raw = raw.toDF(*valid_names(raw.columns))
    return as_types(raw.na.fill(""), infer_types(raw, missing, dates), missing)
