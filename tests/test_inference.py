"""Types of columns from text, by all rows."""

import datetime
import math

import pytest

from folkscope.sources import inference

KINDS = {"boolean": bool, "int": int, "double": float, "date": datetime.date, "string": str}


@pytest.mark.parametrize(
    "cells,kind,values",
    [
        (["T", "FALSE", "NA", " true "], "boolean", [True, False, None, True]),
        (["1", " -7 ", "+3", "", "NA", "2147483647"], "int", [1, -7, 3, None, None, 2147483647]),
        (["1", "2147483648"], "double", [1.0, 2147483648.0]),
        (["1", "2.", ".5", "-1e-3", "Inf", "NA"], "double", [1.0, 2.0, 0.5, -0.001, math.inf, None]),
        (["T", "1"], "string", ["T", "1"]),
        (["1", "", "x", "NA"], "string", ["1", "", "x", None]),
        (["2020-01-31", "NA"], "date", [datetime.date(2020, 1, 31), None]),
        (["2020-01-31", "2020-02-31"], "string", ["2020-01-31", "2020-02-31"]),
        (["NA", "", "NA"], "boolean", [None, None, None]),
        ([], "boolean", []),
        (["9" * 60, "1"], "double", [float("9" * 60), 1.0]),
        (["0x1A", "1"], "string", ["0x1A", "1"]),
        (["1 2"], "string", ["1 2"]),
    ],
)
def test_types_and_values(spark, cells, kind, values):
    raw = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string").orderBy("k").select("c")
    types = inference.infer_types(raw, dates=True)
    assert types["c"].simpleString() == kind
    assert [r["c"] for r in inference.as_types(raw, types).collect()] == values


def test_a_late_text_value_turns_the_column(spark, tmp_path):
    for k in range(4):
        lines = [f"{i},{'late' if i == 3999 else i},{i / 2}" for i in range(1000 * k, 1000 * k + 1000)]
        (tmp_path / f"part{k}.csv").write_text("\n".join(["id,2nd col,half", *lines]) + "\n")
    found = inference.read_csv_inferred(spark, [str(tmp_path / f"part{k}.csv") for k in range(4)], check_names=True)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("id", "int"), ("X2nd.col", "string"), ("half", "double")]
    assert found.count() == 4000
    one = inference.read_csv_inferred(spark, str(tmp_path / "part0.csv"))
    assert one.schema["2nd col"].dataType.simpleString() == "int"


def test_quotes_line_breaks_and_other_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n;t;u\n"1";"a\nb ""c""";-\n-;"NA";7\n;"";8\n')
    found = inference.read_csv_inferred(spark, str(tmp_path / "a.csv"), ";", missing=["-"], multi_line=True)
    assert [f.dataType.simpleString() for f in found.schema] == ["int", "string", "int"]
    assert [tuple(r) for r in found.collect()] == [(1, 'a\nb "c"', None), (None, "NA", 7), (None, "", 8)]


def test_names():
    assert inference.valid_names(["a", "a", "1x", "", "b c", ".2", ".x", "a"]) == ["a", "a.1", "X1x", "X", "b.c", "X.2", ".x", "a.2"]


def test_one_pass(spark):
    raw = spark.createDataFrame([("1", "x")], "a string, b string")
    seen = []
    original = type(raw).agg
    try:
        type(raw).agg = lambda self, *a: seen.append(a) or original(self, *a)
        inference.infer_types(raw)
    finally:
        type(raw).agg = original
    assert len(seen) == 1 and len(seen[0]) == 2
