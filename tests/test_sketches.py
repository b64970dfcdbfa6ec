"""Sketch tables, the quantile search that begins from sketches, and exact ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folkscope.operators import sketches
from folkscope.operators.quantiles import exact_quantiles, exact_ranks

PROBS = {"low": 0.01, "mid": 0.5, "high": 0.9}


def test_parts_merge_and_keep_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.pmod(F.xxhash64("id"), F.lit(10**6)) / 7.0).alias("x"), (F.col("id") % 3).alias("few"))
    merged = sketches.merge_sketches(sketches.sketch_columns(rows, ["x", "few"], ["part"]))
    found = {r["feature"]: r for r in sketches.sketch_summary(merged, PROBS).collect()}
    assert found["x"]["n"] == 60_000 and found["few"]["n_distinct"] == 3 and found["few"]["max"] == 2
    exact = rows.agg(F.count_distinct("x")).first()[0]
    assert abs(found["x"]["n_distinct"] - exact) <= found["x"]["distinct_error"] * exact
    checked = sketches.check_quantiles(rows, sketches.sketch_summary(merged, PROBS), PROBS).collect()
    assert len(checked) == 6 and all(r["within"] for r in checked)


def test_missing_values_empty_tables_and_one_group(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "x double, y double")
    found = {r["feature"]: r for r in sketches.sketch_summary(sketches.sketch_columns(rows, ["x", "y"]), PROBS).collect()}
    assert (found["x"]["n"], found["x"]["n_missing"], found["x"]["min"], found["x"]["mean"]) == (2, 2, 1.0, 2.0)
    assert (found["y"]["n"], found["y"]["mean"], found["y"]["mid"], found["y"]["n_distinct"]) == (0, None, None, 0)
    empty = sketches.sketch_summary(sketches.sketch_columns(rows.where("false"), ["x"]), PROBS).collect()
    assert [(r["n"], r["n_missing"], r["max"]) for r in empty] == [(0, 0, None)]
    assert sketches.sketch_columns(rows.where("false"), ["x"], ["y"]).count() == 0


@pytest.mark.parametrize("limit,size", [(200_000, 8192), (20, 64), (5, 16)])
def test_quantiles_from_coarse_sketches_stay_exact(spark, limit, size):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(0, 1, 4000), np.full(3000, 0.25), rng.integers(0, 5, 2000), [np.inf, -np.inf, 1e300]])
    rows = spark.createDataFrame([(float(v),) for v in data] + [(None,), (float("nan"),)], "x double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.501, 0.77, 0.999, 1.0]
    found = {r["prob"]: r["value"] for r in exact_quantiles(rows, ["x"], probs, 100, limit, size).collect()}
    with np.errstate(invalid="ignore"):
        for p in probs:
            want = np.quantile(data, p)
            assert found[p] == pytest.approx(want) or np.isnan(want), p


def test_exact_ranks(spark):
    rows = spark.createDataFrame([(v, -v) for v in (1.0, 2.0, 2.0, 5.0)] + [(None, float("nan"))], "x double, y double")
    found = {(r["feature"], r["value"]): (r["below"], r["upto"]) for r in exact_ranks(rows, {"x": [2.0, 0.0, 9.0], "y": [-2.0]}).collect()}
    assert found == {("x", 2.0): (1, 3), ("x", 0.0): (0, 0), ("x", 9.0): (4, 4), ("y", -2.0): (1, 3)}
    assert exact_ranks(rows.where("false"), {"x": [1.0]}).first()["upto"] == 0
