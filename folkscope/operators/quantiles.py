"""Exact quantiles without sorting a column in one place."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folkscope.session import materialise

ACCURACY = 10_000
DIRECT_LIMIT = 200_000
SKETCH_SIZE = 8_192


def rank_error(k: int) -> float:
    """How far a rank from a KLL sketch of size k may be off, as a share of the rows, with 99 percent confidence."""
    return 2.296 / k**0.9723


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, NaN as null."""
    return df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    accuracy: int = ACCURACY,
    direct_limit: int = DIRECT_LIMIT,
    sketch_size: int = SKETCH_SIZE,
) -> DataFrame:
    """Linearly interpolated quantiles as rows ``(feature, prob, value)``; nulls and NaN are ignored.

    ``percentile`` keeps every distinct value of a column in one buffer, which
    does not hold for a large continuous column. Here one mergeable KLL sketch per column,
    all from one pass, brackets every wanted rank by ends twice its error away. One more
    pass counts the rows below and on the ends of the brackets, and the values between them
    with their frequencies, of which few are left. Where a bracket holds more than
    ``direct_limit`` rows, as in very large tables, values are not picked yet: it is
    sketched again by itself and counted again, until none does; each round leaves less than a
    hundredth. A sketch that missed a rank, as it may, is seen in the counts and searched
    again in a wider bracket. Only counts and bracket ends pass through the driver.
    """
    values = numbers(df, columns)
    wanted, brackets = _first_brackets(values, columns, probs, sketch_size)
    for b in brackets.values():
        b["expected"] = b["n"] * 4 * rank_error(sketch_size)
    counts, picked = _count_cells(values, brackets, direct_limit)
    heavy = _place(counts, wanted, brackets, set(brackets), direct_limit)
    again = heavy
    while heavy:
        before = {key: (brackets[key]["lo"], brackets[key]["hi"]) for key in heavy}
        _close_in(values, wanted, brackets, heavy, accuracy)
        for key, n in heavy.items():
            brackets[key]["expected"] = n * 8 / accuracy
        # Ends stand still only around a few rows, fewer than a sketch tells apart; those are ranked.
        moved = {key for key in heavy if before[key] != (brackets[key]["lo"], brackets[key]["hi"])}
        if not moved:
            break
        counts, picked = _count_cells(values, brackets, direct_limit)
        heavy = _place(counts, wanted, brackets, moved, direct_limit)
    if again or picked != set(brackets):
        counts, _ = _count_cells(values, brackets, None)
    return _rank_inside(counts, wanted, brackets)


def _first_brackets(values, columns, probs, sketch_size):
    """Wanted 0-based ranks per (column, prob), and the bracket of each from a sketch over all rows."""
    margin = 2.0 * rank_error(sketch_size)
    ends = [min(max(x, 0.0), 1.0) for p in probs for x in (p - margin, p + margin)]
    shares = F.array(*map(F.lit, ends))
    cells = []
    for c in columns:
        sketch = F.kll_sketch_agg_double(c, F.lit(sketch_size))
        asked = F.when(F.count(c) > 0, F.kll_sketch_get_quantile_double(sketch, shares))
        cells.append(F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), asked.alias("ends")).alias(c))
    stats = values.agg(*cells).first()
    wanted, brackets = {}, {}
    for c in columns:
        s = stats[c]
        for k, p in enumerate(probs if s.n else []):
            rank = p * (s.n - 1)
            low_rank = math.floor(rank)
            wanted[c, p] = (low_rank, min(low_rank + 1, s.n - 1), rank - low_rank)
            # Ranks are counted on n - 1 steps and shares on n rows, so on few rows the ends reach one row further.
            few = s.n * margin < 4
            lo = s.lo if few or p <= margin else s.ends[2 * k]
            hi = s.hi if few or p >= 1 - margin else s.ends[2 * k + 1]
            brackets[c, p] = {"lo": lo, "hi": hi, "below": 0, "n": s.n, "whole": (s.lo, s.hi), "misses": 0}
    return wanted, brackets


def _close_in(values, wanted, brackets, heavy, accuracy) -> None:
    """Move the ends of the brackets that hold too many rows towards their ranks, by a sketch of what is inside.

    The distance kept is twice the sketch's error; it grows after a miss, which only a
    sketch beyond its bound can cause. An end that would leave the bracket stays.
    """
    shared: dict[tuple, list] = {}
    for key, inside in heavy.items():
        b, (low_rank, high_rank, _) = brackets[key], wanted[key]
        margin = (2.0 / accuracy + 2.0 / inside) * 4 ** b["misses"]
        low, high = (low_rank - b["below"]) / inside - margin, (high_rank + 1 - b["below"]) / inside + margin
        shared.setdefault((key[0], b["lo"], b["hi"]), []).append((key, low, high))
    cells = []
    for i, ((c, lo, hi), searches) in enumerate(shared.items()):
        shares = [min(max(x, 0.0), 1.0) for _, low, high in searches for x in (low, high)]
        within = F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.col(c))
        cells.append(F.percentile_approx(within, shares, accuracy).alias(f"q{i}"))
    for found, searches in zip(values.agg(*cells).first(), shared.values()):
        for i, (key, low, high) in enumerate(searches if found else []):
            if low > 0:
                brackets[key]["lo"] = found[2 * i]
            if high < 1:
                brackets[key]["hi"] = found[2 * i + 1]


def _edges(brackets, keys) -> dict[str, list[float]]:
    """The distinct ends of the given brackets per column, in order."""
    ends: dict[str, set] = {}
    for key in keys:
        ends.setdefault(key[0], set()).update((brackets[key]["lo"], brackets[key]["hi"]))
    return {c: sorted(e) for c, e in ends.items()}


def cell_counts(values: DataFrame, edges: dict[str, list[float]], picked: dict[str, set[int]]) -> DataFrame:
    """(c, cell, v, n): how many values of column number c lie where among its edges, as cells: 2 j + 1 on edge j, 2 j before it.

    Values of picked cells are counted each by itself. Edges are searched by bisection, a
    batch of rows at a time; a task adds up its batches, so few rows leave it.
    """
    columns = list(edges)
    steps = [np.array(edges[c], float) for c in columns]
    chosen = [np.array(sorted(picked.get(c, ())), np.int64) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 * len(e) + 1, np.int64) for e in steps]
        for batch in batches:
            for k, column in enumerate(batch.columns):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                place = np.searchsorted(steps[k], x)
                cell = 2 * place + (steps[k][np.minimum(place, len(steps[k]) - 1)] == x)
                if len(chosen[k]):
                    apart = np.isin(cell, chosen[k])
                    found, n = np.unique(x[apart], return_counts=True)
                    at = np.searchsorted(steps[k], found)
                    at = 2 * at + (steps[k][np.minimum(at, len(steps[k]) - 1)] == found)
                    if len(found):
                        yield rows_of(k, at, pa.array(found), n)
                    cell = cell[~apart]
                totals[k] += np.bincount(cell, minlength=len(totals[k]))
        for k, n in enumerate(totals):
            at = np.flatnonzero(n)
            yield rows_of(k, at, pa.nulls(len(at), pa.float64()), n[at])

    def rows_of(k: int, cell: np.ndarray, v: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(cell), k, np.int32)), pa.array(cell.astype(np.int32)), v, pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["c", "cell", "v", "n"])

    counted = values.select(*columns).mapInArrow(run, "c int, cell int, v double, n long")
    return counted.groupBy("c", "cell", "v").agg(F.sum("n").alias("n"))


def _inside(ends: list[float], b: dict) -> range:
    """The cells from a bracket's lower end to its upper one."""
    return range(2 * ends.index(b["lo"]) + 1, 2 * ends.index(b["hi"]) + 2)


def _count_cells(values, brackets, direct_limit) -> tuple[DataFrame, set]:
    """Counts by cell of all columns, written, with single values inside the brackets that are expected to hold few."""
    edges = _edges(brackets, brackets)
    picked, keys = {}, set()
    for key, b in brackets.items():
        if direct_limit is None or b["expected"] <= direct_limit or b["lo"] == b["hi"]:
            keys.add(key)
            picked.setdefault(key[0], set()).update(c for c in _inside(edges[key[0]], b) if c % 2 == 0)
    return materialise(cell_counts(values, edges, picked), "cells"), keys


def _place(counts, wanted, brackets, moved, direct_limit) -> dict[tuple, int]:
    """Rows below and inside the moved brackets; returns those that still hold too many, or missed their rank.

    Only rows strictly between the ends of a bracket count as too many: each end is one
    value and will be one row, whatever its frequency.
    """
    edges = _edges(brackets, brackets)
    numbered = dict(enumerate(edges))
    cells = {c: [0] * (2 * len(e) + 1) for c, e in edges.items()}
    for row in counts.groupBy("c", "cell").agg(F.sum("n").alias("n")).collect():
        cells[numbered[row.c]][row.cell] = row.n
    heavy = {}
    for key in moved:
        b, (low_rank, high_rank, _) = brackets[key], wanted[key]
        column, span = cells[key[0]], _inside(edges[key[0]], b)
        b["below"], inside = sum(column[: span.start]), sum(column[span.start : span.stop])
        if b["below"] > low_rank or b["below"] + inside <= high_rank:
            b["lo"], b["hi"] = b["whole"]
            b["below"], heavy[key] = 0, b["n"]
            b["misses"] += 1
        elif sum(column[span.start + 1 : span.stop - 1]) > direct_limit:
            heavy[key] = inside
    return heavy


def _rank_inside(counts, wanted, brackets) -> DataFrame:
    """Rank the distinct values inside the brackets and read off the wanted ranks.

    A bracket that has closed on one value needs no ranking. Brackets of one column
    that coincide are ranked once. Equal values are counted already, so a value that
    fills a third of the table is one row.
    """
    spark, edges = counts.sparkSession, _edges(brackets, brackets)
    numbered = {c: k for k, c in enumerate(edges)}
    slots: dict[tuple, int] = {}
    known, lookups, spans, ends = [], [], [], []
    for (c, p), b in brackets.items():
        low_rank, high_rank, fraction = wanted[c, p]
        if b["lo"] == b["hi"]:
            known.append((c, float(p), float(b["lo"])))
            continue
        if (c, b["lo"], b["hi"]) not in slots:
            slots[c, b["lo"], b["hi"]] = len(slots)
            inside = _inside(edges[c], b)
            spans.append((slots[c, b["lo"], b["hi"]], numbered[c], inside.start, inside.stop - 1))
        lookups.append((slots[c, b["lo"], b["hi"]], c, float(p), low_rank - b["below"], high_rank - b["below"], float(fraction)))
    found = spark.createDataFrame(known, "feature string, prob double, value double")
    if not lookups:
        return found
    schema = "slot int, feature string, prob double, low_rank long, high_rank long, fraction double"
    lookup = spark.createDataFrame(lookups, schema)
    for c, steps in edges.items():
        ends += [(numbered[c], 2 * j + 1, float(e)) for j, e in enumerate(steps)]
    on_edge = spark.createDataFrame(ends, "c int, cell int, edge double")
    runs = counts.join(on_edge, ["c", "cell"], "left").select("c", "cell", F.coalesce("v", "edge").alias("v"), "n")
    span = spark.createDataFrame(spans, "slot int, of int, first_cell int, last_cell int")
    runs = runs.join(span, (F.col("c") == F.col("of")) & F.col("cell").between(F.col("first_cell"), F.col("last_cell")))
    upto = Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = runs.withColumn("last", F.sum("n").over(upto) - 1).withColumn("first", F.col("last") - F.col("n") + 1)

    def covers(rank: str):
        return (F.col("first") <= F.col(rank)) & (F.col(rank) <= F.col("last"))

    hits = ranked.join(lookup, "slot").filter(covers("low_rank") | covers("high_rank"))
    pairs = hits.groupBy("feature", "prob", "fraction").agg(
        F.max(F.when(covers("low_rank"), F.col("v"))).alias("a"),
        F.max(F.when(covers("high_rank"), F.col("v"))).alias("b"),
    )
    value = (F.col("a") + (F.col("b") - F.col("a")) * F.col("fraction")).alias("value")
    return pairs.select("feature", "prob", value).unionByName(found)


def exact_ranks(df: DataFrame, wanted: dict[str, list[float]]) -> DataFrame:
    """(feature, value, below, upto): how many rows lie below each given value, and how many up to it; one pass."""
    edges = {c: sorted(set(v)) for c, v in wanted.items()}
    spark = df.sparkSession
    counts = cell_counts(numbers(df, list(edges)), edges, {})
    numbered = [(k, c, 2 * j + 1, float(e)) for k, (c, steps) in enumerate(edges.items()) for j, e in enumerate(steps)]
    asked = spark.createDataFrame(numbered, "of int, feature string, edge int, value double")
    # Counts are at most two rows per given value and column, so every value meets all cells of its column.
    met = asked.join(counts, F.col("c") == F.col("of"), "left").groupBy("feature", "value")
    return met.agg(
        F.coalesce(F.sum(F.when(F.col("cell") < F.col("edge"), F.col("n"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("cell") <= F.col("edge"), F.col("n"))), F.lit(0)).alias("upto"),
    )
