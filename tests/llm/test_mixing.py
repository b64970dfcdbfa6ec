from collections import defaultdict

import pytest

from folkscope.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, target string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def reference_targets(sizes, cycle=(5, 2, 1), total=1.5, most=2.0):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("slice_rows", [3, 20_000])
def test_targets_and_taken_words(spark, slice_rows):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(400)] + [(1000 + i, "w " * 3, "hot") for i in range(300)]
    rows += [(2000, None, None), (2001, "a b", None), (2002, "", "s0"), (None, "a  b c", "S"), (5, "w w", "s0"), (5, "w w", "s0")]
    out = M.mix_sources(docs_of(spark, rows), slice_rows=slice_rows).collect()
    assert len(out) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size
    want = reference_targets(sizes)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = M.mix_sources(docs_of(spark, rows[::-1]).repartition(7), slice_rows=5).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_epochs_come_first_and_weights_steer(spark):
    rows = [(i, "w w w w", "a" if i < 50 else "b") for i in range(1050)]
    weights = spark.createDataFrame([(i, 50.0 if i % 2 else 0.02) for i in range(50, 1050)], "doc_id long, weight double")
    out = M.mix_sources(docs_of(spark, rows), weights).collect()
    assert all(r.taken == 2 * r.size for r in out if r.source == "a")  # a is small: it reaches its cap
    once = [r for r in out if r.source == "b" and r.picked]
    assert sum(r.doc_id % 2 for r in once) > 0.7 * len(once)


def test_empty_tables(spark):
    assert M.mix_sources(docs_of(spark, [])).count() == 0
    assert [r.taken for r in M.mix_sources(docs_of(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [0, 0]


def test_plan_has_no_python(spark):
    out = M.mix_sources(docs_of(spark, [(1, "a b", "s")]))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
