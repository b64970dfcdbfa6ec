import math
import random

import pytest
from pyspark.sql import functions as F

from folkscope.llm import topk as T

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def brute(rows, k=20, every=20):
    usable = [(i, x) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    whole = lambda v: 64 * v.as_integer_ratio()[0] // v.as_integer_ratio()[1]
    ints = [(i, [whole(float(v)) for v in x]) for i, x in usable]
    queries = {}
    for (i, x), (_, y) in zip(usable, ints, strict=True):
        if i % every == 0 and (i not in queries or x < queries[i][0]):
            queries[i] = (x, y)
    out = []
    for q, (_, y) in queries.items():
        scores = sorted((-min(max(sum(a * b for a, b in zip(y, c, strict=False)), T.LEAST), T.MOST), i) for i, c in ints if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def mine(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, T.search_top_k(frame, F.col("vec_id") % 20 == 0, **kw).collect()))


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 2000, "sample_rows": 5}, {"sample_rows": 0}])
def test_against_all_pairs(spark, kw):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(19)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")]), (2060, [float("inf")]), (None, [1.0]), (2080, []), (3001, [0.5] * 25)]
    rows += [(2100, [0.1] * 19), (2100, [-0.1] * 19), (40, rows[40][1])]
    assert mine(spark, rows, **kw) == brute(rows)


def test_large_numbers(spark):
    rows = [(20 * i, [1e9 * i + 0.5, -3e5, 1e8]) for i in range(5)] + [(1, [1e200, 1.0]), (3, [1e308, -1e308]), (100, [1e308])]
    assert mine(spark, rows) == brute(rows)


@pytest.mark.parametrize("far", [1e6, 1e9, 1e300])
def test_large_candidates_of_ordinary_queries(spark, far):
    rows = [(20, [1.0, 2.0]), (1, [far, 0.0]), (2, [0.5, 0.0])]
    for _ in range(2):  # what one call leaves behind must not reach the next
        assert mine(spark, rows) == brute(rows)
        assert mine(spark, rows[:1] + rows[2:]) == brute(rows[:1] + rows[2:])


def test_few_rows(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(20, [1.0])]) == []
    assert mine(spark, [(20, [1.0]), (21, [2.0])]) == [(20, 1, 21, 64 * 128)]
    assert mine(spark, [(21, [1.0])]) == []


def test_bounds_drop_candidates_but_not_results():
    rng = T.np.random.default_rng(0)
    vectors = T.np.floor(64 * rng.normal(0, 1, (3000, 32)) * T.np.geomspace(1, 0.01, 32))
    block = T.Block(T.np.array([-1]), vectors[:1], 20, T.np.full(1, -T.np.inf))
    block.search(T.np.arange(3000), vectors)
    scores = vectors @ vectors[0]
    order = T.np.lexsort((T.np.arange(3000), -scores))[:20]
    assert [i for _, i in block.best[0]] == order.tolist()
