"""Formula text: what is parsed, how terms are coded, and fits against dense designs."""

import numpy as np
import pytest

from folkscope.operators import formulas, models

COLUMNS = ["y", "m", "o", "a", "b", "x", "z", "odd name"]


@pytest.mark.parametrize(
    "text,terms,intercept",
    [
        ("y ~ a + x", [("a",), ("x",)], True),
        ("y ~ a*b", [("a",), ("b",), ("a", "b")], True),
        ("y ~ a:x + a - 1", [("a",), ("a", "x")], False),
        ("y ~ 0 + x", [("x",)], False),
        ("y ~ 1", [], True),
        ("y ~ -1 + a", [("a",)], False),
        ("y ~ a/x", [("a",), ("a", "x")], True),
        ("y ~ a*b*x - a:b:x - b:x", [("a",), ("b",), ("x",), ("a", "b"), ("a", "x")], True),
        ("y ~ (a + b):x", [("a", "x"), ("b", "x")], True),
        ("y ~ (a + b)*x - b", [("a",), ("x",), ("a", "x"), ("b", "x")], True),
        ("y ~ a:b + b:a", [("a", "b")], True),
        ("y ~ . - m - o - `odd name`", [("a",), ("b",), ("x",), ("z",)], True),
        ("cbind(m, o) ~ a + offset(z)", [("a",)], True),
        ("cbind(m,o) ~ . - y - offset(z)", [("a",), ("b",), ("x",), ("odd name",)], True),
    ],
)
def test_parse(text, terms, intercept):
    found = formulas.parse(text, COLUMNS)
    assert list(found.terms) == terms and found.intercept is intercept
    assert found.response == (("m", "o") if "cbind" in text else ("y",))
    assert found.offset == ("z" if "offset" in text else None)


@pytest.mark.parametrize("text", ["y + a", "y ~ a +", "y ~ a b", "y ~ a ^ 2", "y ~ nowhere", "y ~ (a", "y ~ a ~ b", "w ~ a", "y ~ 7"])
def test_refused(text):
    with pytest.raises(ValueError):
        formulas.parse(text, COLUMNS)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(300):
        a, b, x, z = "pqr"[i % 3], "uv"[i % 2], float(rng.normal()), float(rng.normal())
        n = int(rng.integers(3, 40))
        p = 1 / (1 + np.exp(-(0.3 * (a == "q") - 0.5 * x * (a == "r") + 0.2 * z)))
        m = int(rng.binomial(n, p))
        data.append((i, a, b, x, z, m, n - m))
    data += [(900, None, "u", 0.1, 0.1, 3, 3), (901, "p", "u", None, 0.1, 3, 3)]
    return spark.createDataFrame(data, "id int, a string, b string, x double, z double, m int, o int").cache()


def columns_of(rows, names):
    """Design columns from their names alone."""
    out = []
    for name in names:
        col = np.ones(len(rows))
        for part in [] if name == "(Intercept)" else name.split(":"):
            v, _, level = part.partition("_")
            col = col * np.array([float(r[v] == level) if level else r[v] for r in rows])
        out.append(col)
    return np.array(out).T


@pytest.mark.parametrize(
    "right,names",
    [
        ("a*x", ["(Intercept)", "a_q", "a_r", "x", "a_q:x", "a_r:x"]),
        ("a/x - 1", ["a_p", "a_q", "a_r", "a_p:x", "a_q:x", "a_r:x"]),
        ("a*b", ["(Intercept)", "a_q", "a_r", "b_v", "a_q:b_v", "a_r:b_v"]),
        ("a:b - 1", ["a_p:b_u", "a_q:b_u", "a_r:b_u", "a_p:b_v", "a_q:b_v", "a_r:b_v"]),
        ("a + b + z - 1", ["a_p", "a_q", "a_r", "b_v", "z"]),
        ("x:z + x", ["(Intercept)", "x", "x:z"]),
    ],
)
def test_fits_as_dense_designs(spark, rows, right, names):
    fit = formulas.fit_formula(rows, f"cbind(m, o) ~ {right}")
    assert fit.names == names
    kept = [r for r in rows.collect() if r["a"] is not None and r["x"] is not None or "x" not in right and r["a"] is not None]
    kept = kept if "a" in right else [r for r in rows.collect() if r["x"] is not None]
    X = columns_of(kept, names)
    m, n = np.array([r["m"] for r in kept], float), np.array([r["m"] + r["o"] for r in kept], float)
    beta = np.zeros(X.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-X @ beta))
        beta = beta + np.linalg.solve(X.T @ (X * (n * p * (1 - p))[:, None]), X.T @ (m - n * p))
    assert fit.coefficients == pytest.approx(beta, abs=1e-7) and fit.rows == len(kept)
    wide = models.design_matrix(rows.where("id < 900"), fit.plan.predictors, ["id"], fit.plan).orderBy("id").drop("id").toPandas()
    assert np.allclose(wide.to_numpy(float), columns_of(rows.where("id < 900").orderBy("id").collect(), names))


def test_zero_one_text_response_and_offset(spark, rows):
    single = rows.where("id < 900").selectExpr("a", "x", "IF(m > o, 'yes', 'no') AS answer", "IF(m > o, 1, 0) AS y", "z")
    a = formulas.fit_formula(single, "answer ~ a + x + offset(z)", "yes")
    b = formulas.fit_formula(single, "y ~ a + x + offset(z)")
    want = models.fit_bernoulli(single, "y", ["a", "x"], offset="z")
    assert a.coefficients == pytest.approx(want.coefficients, abs=1e-8) and b.coefficients == pytest.approx(a.coefficients)
    less = formulas.without(formulas.parse("y ~ a*x + z", single.columns), "x")
    assert less.terms == (("a",), ("z",))
