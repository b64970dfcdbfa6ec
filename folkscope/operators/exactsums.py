"""Sums and means of doubles that do not depend on the order of rows.

A double is a whole number of units of its last bit. Here every value is cut, without
error, into digits of base 2**24 at fixed places: the value divided by its place, taken
modulo 2**24 and truncated; division by a power of two and the remainder are exact.
Digits are whole numbers, so their sums are exact and the same for any partitioning and any
order; 24 bits a row leave room for 2**39 rows in 64 bits. A group's digit sums are its whole
state: those of finer groups add up to those of coarser ones. Rounding happens once, at the end.

One aggregate over the magnitudes finds the places that the data needs, four for numbers
like prices; a caller who knows them saves that pass.

Defined cases: nulls are skipped, or with ``strict`` make the result null; a group without
values has a null sum; infinities and NaN give what adding them gives.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT_BITS = 24
LAST_BIT = 52  # bits of a double behind its first
LEAST_PLACE = -1074 // DIGIT_BITS


def _finite(col: str) -> Column:
    x = F.col(col).cast("double")
    return F.when((F.abs(x) < float("inf")) & ~F.isnan(x), x)


def digit_places(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """Per column the lowest and highest place that its values reach, from one aggregate."""
    cells = []
    for c in columns:
        size = F.abs(_finite(c))
        cells += [F.min(F.when(size > 0, size)), F.max(size)]
    found = df.agg(*[cell.alias(f"c{i}") for i, cell in enumerate(cells)]).first()
    places = {}
    for i, c in enumerate(columns):
        low, high = found[2 * i], found[2 * i + 1]
        if low is None:
            places[c] = (0, 0)
        else:
            last = math.frexp(low)[1] - 1 - LAST_BIT
            places[c] = max(last // DIGIT_BITS, LEAST_PLACE), (math.frexp(high)[1] - 1) // DIGIT_BITS
    return places


def _digits(col: str, low: int, high: int) -> list[Column]:
    """The digits of a value from the lowest place to the highest, all of its own sign."""
    out = []
    for place in range(low, high + 1):
        # 2.0 ** -1074 is the least double, and its inverse is none: scaling goes in two steps.
        half = place * DIGIT_BITS // 2
        scaled = _finite(col) / F.lit(2.0**half) / F.lit(2.0 ** (place * DIGIT_BITS - half))
        # A value that scaling takes beyond all doubles has its last bit far above this place.
        digit = F.when(F.abs(scaled) < float("inf"), (scaled % float(1 << DIGIT_BITS)).cast("long"))
        out.append(digit)
    return out


def digit_sums(df: DataFrame, by: list[str], columns: list[str], places: dict[str, tuple[int, int]]) -> DataFrame:
    """The exact state of every group: per column a struct of count, nulls, special values and digit sums."""
    states = []
    for c in columns:
        x = F.col(c).cast("double")
        states.append(
            F.struct(
                F.count(x).alias("n"),
                F.count_if(x.isNull()).alias("nulls"),
                F.sum(F.when(_finite(c).isNull(), x)).alias("special"),
                F.array(*[F.coalesce(F.sum(d), F.lit(0).cast("long")) for d in _digits(c, *places[c])]).alias("digits"),
            ).alias(c)
        )
    return df.groupBy(*by).agg(*states)


def merge_digit_sums(states: DataFrame, by: list[str], columns: list[str], places: dict[str, tuple[int, int]]) -> DataFrame:
    """States of coarser groups from those of finer ones."""
    merged = []
    for c in columns:
        low, high = places[c]
        sums = [F.sum(F.get(f"{c}.digits", F.lit(i))) for i in range(high - low + 1)]
        merged.append(
            F.struct(
                F.sum(f"{c}.n").alias("n"), F.sum(f"{c}.nulls").alias("nulls"), F.sum(f"{c}.special").alias("special"),
                F.array(*sums).alias("digits"),
            ).alias(c)
        )
    return states.groupBy(*by).agg(*merged)


def _whole(digits) -> int:
    return sum(int(d) << (DIGIT_BITS * i) for i, d in enumerate(digits))


def _ratio(top: int, bottom: int) -> float:
    """Division of whole numbers, rounded once; beyond the largest double, infinity."""
    try:
        return top / bottom
    except OverflowError:
        return math.inf if top > 0 else -math.inf


def rounded_sum(state: str, place: tuple[int, int], strict: bool = True, mean: bool = False) -> Column:
    """The double nearest to a state's exact sum, or mean."""
    shift = place[0] * DIGIT_BITS

    @F.pandas_udf("double")
    def near(digits: pd.Series, n: pd.Series) -> pd.Series:
        up, down = (1 << max(shift, 0)), (1 << max(-shift, 0))
        values = [_ratio(_whole(d) * up, down * (max(int(k), 1) if mean else 1)) for d, k in zip(digits, n, strict=True)]
        return pd.Series(values, dtype="float64")

    count = F.col(f"{state}.n")
    special = F.col(f"{state}.special")
    value = F.when(special.isNotNull(), special).otherwise(near(F.col(f"{state}.digits"), count))
    known = count > 0
    if strict:
        known = known & (F.col(f"{state}.nulls") == 0)
    return F.when(known, value)


def sum_in_units(state: str, place: tuple[int, int], bits: int) -> Column:
    """The exact sum as a whole number of units of ``2**-bits``, as text; null if it is none."""
    shift = place[0] * DIGIT_BITS + bits

    @F.pandas_udf("string")
    def units(digits: pd.Series) -> pd.Series:
        out = []
        for d in digits:
            whole = _whole(d)
            if shift >= 0:
                out.append(str(whole << shift))
            else:
                out.append(None if whole % (1 << -shift) else str(whole >> -shift))
        return pd.Series(out, dtype="object")

    return F.when((F.col(f"{state}.n") > 0) & F.col(f"{state}.special").isNull(), units(F.col(f"{state}.digits")))


def exact_sums(df: DataFrame, by: list[str], columns: list[str], strict: bool = True) -> DataFrame:
    """``column_sum`` and ``column_mean`` of every group, each rounded once from the exact sum."""
    places = digit_places(df, columns)
    states = digit_sums(df, by, columns, places)
    cells = []
    for c in columns:
        cells += [rounded_sum(c, places[c], strict).alias(f"{c}_sum"), rounded_sum(c, places[c], strict, mean=True).alias(f"{c}_mean")]
    return states.select(*by, *cells)


def exact_weighted_shares(df: DataFrame, group: str, answer: str, weight: str = "weight") -> DataFrame:
    """Weighted count, group size and share of every answer, to the last bit the same in any order of rows.

    The sizes of groups come from the states of their answers, so rows are read once. A missing
    weight voids the answer's count and the size of its group.
    """
    places = digit_places(df, [weight])
    states = digit_sums(df, [group, answer], [weight], places)
    counts = states.select(group, answer, rounded_sum(weight, places[weight]).alias("weighted_n"))
    whole = merge_digit_sums(states, [group], [weight], places)
    sizes = whole.select(F.col(group).alias("_group"), rounded_sum(weight, places[weight]).alias("weighted_group_size"))
    joined = counts.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return joined.withColumn("weighted_estimate", F.col("weighted_n") / F.col("weighted_group_size"))
