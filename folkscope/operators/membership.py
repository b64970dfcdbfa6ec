"""Membership in a set that is itself a table.

A short list of values is a literal (``functions.conditions.member_of``). A set of any size
is a table, and membership is a left-semi join. So that rows without a partner do not cross
the network for it, a Bloom filter of the set stands in front of the join: its words of 64
bits are made by one aggregation of the set, and the scan of the large table tests them as a
scalar subquery. What the filter lets through by mistake, the exact join removes.

Defined cases: a missing value is no member, whatever the set holds; repeated and missing
keys of the set change nothing; an empty set has no members; other columns of the set are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BITS = 12  # bits per distinct key: about one row in 300 passes by mistake
PROBES = 6
MAX_BITS = 1 << 26  # 8 MB, the bound of what each task is sent; a larger set goes without a filter


def _places(key: Column, bits: int) -> list[Column]:
    """The bits of a key: two hashes, one a step that the other takes."""
    first, step = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    mask = (1 << 40) - 1
    start, step = first.bitwiseAND(F.lit(mask)), step.bitwiseAND(F.lit(mask))
    return [F.pmod(start + i * step, F.lit(bits)) for i in range(PROBES)]


def filter_bits(n_keys: int) -> int | None:
    """Size of the filter for a set: a power of two, at least 64; None where it would pass the bound."""
    bits = 64
    while bits < n_keys * KEY_BITS:
        bits *= 2
    return bits if bits <= MAX_BITS else None


def bloom_words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with the filter as an array of words; partial aggregation per word before anything is moved.

    The words are ``bits / 64`` at most, so the last step holds no more than the bound.
    """
    place = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    word = F.shiftright("place", 6).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    found = place.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = found.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))


def may_contain(words: Column, value: Column, bits: int) -> Column:
    """False only for values that are certainly no key."""
    passed = F.lit(True)
    for place in _places(value, bits):
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        shifted = F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int"))
        passed = passed & (shifted.bitwiseAND(F.lit(1)) == 1)
    return passed


def _set_of(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The set's keys in the column's type, which both sides hash alike."""
    return keys.select(F.col(key).cast(df.schema[column].dataType).alias("_member")).where("_member IS NOT NULL")


def in_table(df: DataFrame, column: str, keys: DataFrame, key: str, n_keys: int | None = None) -> DataFrame:
    """Rows whose value is among ``keys[key]``.

    ``n_keys``: about how many distinct keys there are; without it they are counted by one
    approximate aggregate. Keys are read in the column's type.
    """
    members = _set_of(df, column, keys, key)
    if n_keys is None:
        n_keys = members.agg(F.approx_count_distinct("_member")).first()[0]
    bits = filter_bits(n_keys)
    if bits is not None:
        words = bloom_words(members, "_member", bits).scalar()
        df = df.where(F.col(column).isNotNull() & may_contain(words, F.col(column), bits))
    return df.join(members, F.col(column) == F.col("_member"), "left_semi")


def not_in_table(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose value is not among the keys; a missing value is no member, so its row stays."""
    members = _set_of(df, column, keys, key)
    return df.join(members, F.col(column) == F.col("_member"), "left_anti")


def flag_in_table(df: DataFrame, column: str, keys: DataFrame, key: str, name: str) -> DataFrame:
    """1 for members, 0 for all others, missing values too."""
    members = _set_of(df, column, keys, key).distinct()
    joined = df.join(members, F.col(column) == F.col("_member"), "left")
    return joined.withColumn(name, F.when(F.col("_member").isNotNull(), 1).otherwise(0)).drop("_member")
