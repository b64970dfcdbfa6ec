"""Frequent values, triangular factors and replaced ranges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folkscope.operators import frequent, leastsquares, models
from folkscope.sources import delimited


def plain(rows, top):
    counts = {}
    for v in rows:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    n = sum(counts.values())
    return [(r, v, c, c / n) for r, (v, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top], 1)]


@pytest.mark.parametrize("capacity", [4, 15, 60, 4096])
@pytest.mark.parametrize("shape", ["skewed", "flat", "late"])
def test_no_frequent_value_is_missed(spark, capacity, shape):
    rng = np.random.default_rng(1)
    if shape == "skewed":
        rows = [f"v{int(x)}" for x in rng.zipf(1.3, 4000) if x < 10**6] + [None] * 50
    elif shape == "flat":
        rows = [f"v{i}" for i in range(1500)] * 2 + ["v7"]
    else:  # a value that is rare in every task but frequent in all
        rows = [f"u{i}" for i in range(3000)] + [f"w{i % 6}" for i in range(600)]
    frame = spark.createDataFrame([(r,) for r in rows], "v string").repartition(7)
    found = [tuple(r)[1:] for r in frequent.frequent_values(frame, ["v"], 5, capacity).orderBy("rank").collect()]
    assert found == plain(rows, 5)


def test_types_empty_tables_and_columns_without_values(spark):
    frame = spark.createDataFrame([(1, 0.5, None), (1, -0.0, None), (2, 0.0, None)], "i int, d double, none string")
    found = {(r["feature"], r["rank"]): (r["value"], r["n"]) for r in frequent.frequent_values(frame, ["i", "d", "none"], 2).collect()}
    assert found[("i", 1)] == ("1", 2) and found[("i", 2)] == ("2", 1) and ("none", 1) not in found
    assert frequent.frequent_values(frame.where("false"), ["i"]).collect() == []


def test_a_summary_is_small_and_bounds_counts():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    values, n = np.unique(rng.zipf(1.5, 5000), return_counts=True)
    held, pruned = frequent.prune(pa.table({"v": values, "n": n}), 10)
    assert held.num_rows <= 10 and pruned <= n.sum() / 11
    true = dict(zip(values.tolist(), n.tolist(), strict=True))
    for v, c in zip(held["v"].to_pylist(), held["n"].to_pylist(), strict=True):
        assert c <= true[v] <= c + pruned


@pytest.fixture(scope="module")
def collinear(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(50, 3, 900), rng.normal(size=900)
    y = 2 + 0.5 * x + 3 * z + rng.normal(size=900)
    near = x + 1e-6 * z
    level = ["p" if i % 3 else "q" for i in range(900)]
    rows = [tuple(map(float, r)) + (lv,) for r, lv in zip(np.array([x, z, near, y, x + z]).T, level, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0, "p")]
    return spark.createDataFrame(rows, "x double, z double, near double, y double, total double, level string").repartition(5), x, z, near, y


def test_near_collinear_terms_keep_their_digits(collinear):
    frame, x, z, near, y = collinear
    fit = leastsquares.fit_linear_qr(frame, "y", ["x", "near"])
    base = np.linalg.lstsq(np.column_stack([np.ones(900), x, (near - x) / 1e-6]), y, rcond=None)[0]
    found = {t[0]: t[1] for t in fit.table}
    assert found["near"] == pytest.approx(base[2] / 1e-6, rel=1e-6)
    gram = np.column_stack([np.ones(900), x, near])
    normal = np.linalg.solve(gram.T @ gram, gram.T @ y)  # what sums of squares give
    assert abs(normal[2] * 1e-6 / base[2] - 1) > 1e-4


def test_as_the_normal_equations_where_these_suffice(spark, collinear):
    frame = collinear[0]
    a = leastsquares.fit_linear_qr(frame, "y", ["x", "z", "level", "total"])
    b = models.fit_linear(frame, "y", ["x", "z", "level", "total"])
    assert a.names == b.names and a.residual_df == b.residual_df
    for mine, theirs in zip(a.table, b.table, strict=True):
        assert mine[0] == theirs[0] and (mine[1:] == theirs[1:] == (None,) * 4 or mine[1:4] == pytest.approx(theirs[1:4], rel=1e-6))
        assert mine[4] is None or mine[4] == pytest.approx(theirs[4], abs=1e-9)
    assert (a.r2, a.adjusted_r2, a.sigma, a.f_statistic) == pytest.approx((b.r2, b.adjusted_r2, b.sigma, b.f_statistic), rel=1e-6)


def test_inflation_and_condition(collinear):
    frame, x, z, _, _ = collinear
    triangle = leastsquares.factorise(frame, "y", ["x", "z"])
    r2 = np.corrcoef(x, z)[0, 1] ** 2
    assert leastsquares.inflation(triangle) == pytest.approx({"x": 1 / (1 - r2), "z": 1 / (1 - r2)})
    X = np.column_stack([np.ones(900), x, z])
    s = np.linalg.svd(X / np.linalg.norm(X, axis=0), compute_uv=False)
    assert leastsquares.condition_indexes(triangle) == pytest.approx(list(s[0] / s))
    with pytest.raises(ValueError):
        leastsquares.factorise(frame.where("false"), "y", ["x"])


def test_student_tail():
    assert leastsquares.student_tail(1.0, 1) == pytest.approx(0.5)
    assert leastsquares.student_tail(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6))
    assert leastsquares.student_tail(1.96, 10**7) == pytest.approx(0.05, abs=1e-5) and leastsquares.student_tail(0.0, 5) == 1.0


def test_a_range_is_replaced_and_others_stay(spark, tmp_path):
    rows, path = spark.range(100).select("id", F.lit("old").alias("v")), str(tmp_path / "ranges")
    delimited.write_id_ranges(rows, "id", 30, path, replace=True)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "ranges").rglob("part*") if "range_start=30" not in str(p)}
    delimited.write_id_ranges(rows.where("id BETWEEN 30 AND 40").withColumn("v", F.lit("new")), "id", 30, path, replace=True)
    found = delimited.read_ranges(spark, path, "id long, v string")
    counts = {(r["range_start"], r["v"]): r["count"] for r in found.groupBy("range_start", "v").count().collect()}
    assert counts == {(0, "old"): 30, (30, "new"): 11, (60, "old"): 30, (90, "old"): 10}
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "ranges").rglob("part*") if "range_start=30" not in str(p)}
    with pytest.raises(Exception, match="already exists"):
        delimited.write_id_ranges(rows, "id", 30, path)
