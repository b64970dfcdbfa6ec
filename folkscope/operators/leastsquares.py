"""Least squares by a tall-skinny QR factorisation.

Sums of squares lose twice the digits that the terms' collinearity costs. Here every task
reduces its rows, with the response as last column, to a triangular factor by orthogonal
steps, and factors are stacked and reduced again, some at a time, until one is left
(Demmel et al., "Communication-optimal parallel and sequential QR", 2012). Estimates,
errors, inflation and condition indexes all come from that triangle. A factor has
(terms + 1) squared numbers, whatever the rows; the number of terms is bounded.

Defined cases: incomplete rows are left out; a term that is a sum of earlier ones is reported
without estimate; fewer rows than terms leave no degrees of freedom, and errors are null; no
complete row at all is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkscope.operators.models import Design, LinearFit, design
from folkscope.session import materialise

MAX_TERMS = 500
FAN_IN = 64  # factors that one task stacks
DEPENDENT = 1e-11  # what is left of a term's length, as a share, below which it is a sum of earlier ones


@dataclass(frozen=True)
class Triangle:
    """The factor of terms and response: ``r`` is upper triangular, its last column belongs to the response."""

    names: list[str]
    r: np.ndarray
    rows: int
    plan: Design


def reduce_rows(block: np.ndarray) -> np.ndarray:
    """The triangle of some rows; it has no more rows than columns."""
    return np.linalg.qr(block, mode="r") if len(block) else block


def stacked(frames: DataFrame, width: int) -> DataFrame:
    """(r, n): one triangle per task from rows ``r`` of numbers, each standing for n rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((0, width)), 0
        for batch in batches:
            block = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held, n = reduce_rows(np.concatenate([held, block])), n + sum(batch.column(1).to_pylist())
        if n:
            flat = pa.ListArray.from_arrays(pa.array([0, held.size], pa.int32()), pa.array(held.reshape(-1)))
            yield pa.RecordBatch.from_arrays([flat, pa.array([n], pa.int64())], names=["r", "n"])

    return frames.mapInArrow(run, "r array<double>, n long")


def factorise(df: DataFrame, response: str, predictors: list[str], plan: Design | None = None) -> Triangle:
    """The triangle of all complete rows of ``response ~ predictors``."""
    complete = df.dropna(subset=[response, *predictors])
    plan = plan or design(complete, predictors)
    width = len(plan.names) + 1
    if width > MAX_TERMS:
        raise ValueError(f"{width - 1} terms; at most {MAX_TERMS - 1}")
    y = F.col(response).cast("double")
    values = F.array(*[c.cast("double") for _, c in plan.terms()], y)
    rows = complete.select(values.alias("r"), F.lit(1).cast("long").alias("n")).where(~F.exists("r", lambda x: x.isNull() | F.isnan(x)))
    level = stacked(rows, width)
    level = materialise(level, "triangles")
    tasks = level.count()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        level = stacked(level.repartition(tasks), width)
    found = level.collect()  # at most FAN_IN triangles
    if not found:
        raise ValueError("no row has the response and all predictors")
    blocks = np.concatenate([np.array(f["r"]).reshape(-1, width) for f in found])
    r = reduce_rows(blocks)
    r = np.concatenate([r, np.zeros((width - len(r), width))])
    return Triangle(plan.names, r, sum(f["n"] for f in found), plan)


def independent_terms(triangle: Triangle) -> tuple[list[int], np.ndarray]:
    """Places of the terms that are no sum of earlier ones, and the triangle of those and the response."""
    k, kept = len(triangle.names), []
    for j in range(k):
        columns = np.linalg.qr(triangle.r[:, [*kept, j]], mode="r")
        length = np.linalg.norm(triangle.r[:, j])
        if length > 0 and abs(columns[-1, -1] if len(columns) > len(kept) else 0.0) > DEPENDENT * length:
            kept.append(j)
    return kept, np.linalg.qr(triangle.r[:, [*kept, k]], mode="r")


def back_substitute(r: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros_like(right, float)
    for j in range(len(r) - 1, -1, -1):
        out[j] = (right[j] - r[j, j + 1 :] @ out[j + 1 :]) / r[j, j]
    return out


def student_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t: an incomplete beta function by its continued fraction."""
    if math.isnan(t) or df <= 0:
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 10_000):
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + n * d or 1e-300)
                c = 1 + n / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x in (0.0, 1.0):
        return x
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def fit_linear_qr(df: DataFrame, response: str, predictors: list[str], plan: Design | None = None) -> LinearFit:
    """Ordinary least squares from the triangle; tables as from ``models.fit_linear``."""
    triangle = factorise(df, response, predictors, plan)
    kept, r = independent_terms(triangle)
    k = len(kept)
    square, right = r[:k, :k], r[:k, k]
    estimates = back_substitute(square, right)
    inverse = np.array([back_substitute(square, e) for e in np.eye(k)]).T
    left, dof = float(np.sum(r[k:, k] ** 2)), triangle.rows - k
    total = float(np.sum(r[:, k] ** 2))
    if triangle.plan.intercept:
        # The response less its mean: what the intercept alone leaves.
        ones = np.linalg.qr(triangle.r[:, [0, len(triangle.names)]], mode="r")
        total = float(np.sum(ones[1:, 1] ** 2))
    sigma = math.sqrt(left / dof) if dof > 0 else math.nan
    errors = sigma * np.sqrt((inverse**2).sum(axis=1))
    found = {}
    for i, b, e in zip(kept, estimates, errors, strict=True):
        known = dof > 0 and e > 0
        found[triangle.names[i]] = (float(b), float(e) if known else None, float(b / e) if known else None, student_tail(float(b / e), dof) if known else None)
    table = [(n, *found.get(n, (None,) * 4)) for n in triangle.names]
    r2 = 1 - left / total if total > 0 else math.nan
    slopes, free = k - triangle.plan.intercept, triangle.rows - triangle.plan.intercept
    adjusted = 1 - (1 - r2) * free / dof if dof > 0 else math.nan
    f = (r2 / slopes) / ((1 - r2) / dof) if slopes > 0 and dof > 0 and r2 < 1 else math.nan
    return LinearFit(triangle.plan, triangle.names, table, r2, adjusted, sigma, dof, f)


def inflation(triangle: Triangle) -> dict[str, float]:
    """Variance inflation of every independent term beside the intercept, from the triangle."""
    kept, r = independent_terms(triangle)
    own = [i for i in kept if not (triangle.plan.intercept and i == 0)]
    columns = triangle.r[:, own]
    if triangle.plan.intercept:  # what is left of the terms after their means
        columns = np.linalg.qr(triangle.r[:, [0, *own]], mode="r")[1:, 1:]
    square = np.linalg.qr(columns, mode="r")
    inverse = np.array([back_substitute(square, e) for e in np.eye(len(own))]).T
    values = (square**2).sum(axis=0) * (inverse**2).sum(axis=1)
    return {triangle.names[i]: float(v) for i, v in zip(own, values, strict=True)}


def condition_indexes(triangle: Triangle) -> list[float]:
    """Largest singular value over each, of the independent terms scaled to equal length."""
    kept, _ = independent_terms(triangle)
    columns = triangle.r[:, kept]
    singular = np.linalg.svd(columns / np.linalg.norm(columns, axis=0), compute_uv=False)
    return [float(singular[0] / s) for s in singular]
