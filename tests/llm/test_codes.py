import math
import random

import numpy as np
import pytest

from folkscope.llm import codes as C

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    whole = lambda v: scale * v.as_integer_ratio()[0] // v.as_integer_ratio()[1]
    kept = [(i, lab, x) for i, x, lab in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max((len(x) for _, _, x in kept), default=0) // parts)
    cut = [[([whole(float(v)) for v in x] + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(members[k]) for col in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    out = []
    for (i, lab, _), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), C.MOST)))
    return sorted(out, key=repr), books


def mine(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    coded, books = C.quantise(frame, **kw)
    return sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in coded.collect()), key=repr), books


def same(spark, rows, **kw):
    found, books = mine(spark, rows, **kw)
    want, want_books = brute(rows, **kw)
    assert found == want
    if want:
        assert books[-1].tolist() == want_books
    return books


def gauss(rng, n, width=32):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(40)]
    return [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"parts": 5, "entries": 7, "rounds": 4}, {"rounds": 0}, {"entries": 2, "rounds": 3}])
def test_against_plain_rounds(spark, kw):
    rows = gauss(random.Random(1), 500)
    rows += [(1000 + k, rows[3][1], 5) for k in range(150)]  # a large group of copies: ties
    same(spark, rows, **kw)


def test_rows_of_any_kind(spark):
    rng = random.Random(2)
    rows = gauss(rng, 90, 19) + [(None, [0.5] * 19, 1), (None, [0.25] * 19, 1), (3, [0.1] * 19, None), (3, [0.1] * 19, None), (-5, [], 7)]
    rows += [(6, None, 1), (7, [1.0, None], 1), (8, [float("nan")], 1), (9, [float("-inf")], 1), (200, [0.1] * 4, 2)]
    same(spark, rows)
    same(spark, [(1, [], 1), (2, [], None)])
    same(spark, rows[:3])
    assert mine(spark, [])[0] == []
    assert mine(spark, [(1, None, 1)])[0] == []


@pytest.mark.parametrize("far", [1e5, 1e9, 1e40, 1e200, 1e308])
def test_large_numbers(spark, far):
    rng = random.Random(3)
    rows = [(i, [far * rng.choice([-1, 1, 0.3, 1e-4, 0]) for _ in range(8)], i % 2) for i in range(150)]
    same(spark, rows, parts=4, entries=9)


def test_bounds_spare_scans_and_stay_true():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (1, 64, 4))
    x = (centres[:, rng.integers(0, 64, 4000)] + rng.integers(-40, 40, (1, 4000, 4))).transpose(1, 0, 2)
    books, state, scans = [x[:64].transpose(1, 0, 2).copy()], C.Assigned.unknown(4000, 1), []
    for _ in range(6):
        state.scanned = 0
        known = C.Codebooks(books)
        C.assign(x, known, state)
        scans.append(state.scanned)
        distances = ((x[:, :, None] - books[-1][None]) ** 2).sum(-1)  # rows, 1, entries
        assert (state.code == distances.argmin(-1)).all()
        now = books[-1].copy()
        for e in np.unique(state.code):
            now[0, e] = x[state.code[:, 0] == e, 0].sum(0) // (state.code == e).sum()
        books.append(now)
        # Every bound, carried by net displacements, holds against the next codebook.
        after = C.Codebooks(books)
        real = np.sqrt(((x[:, 0, None] - now) ** 2).sum(-1))
        code = state.code[:, 0].astype(int)
        assert (state.upper[:, 0] + after.moved[state.upper_stamp[:, 0], 0, code] >= real[np.arange(4000), code]).all()
        for g, members in enumerate(after.groups):
            others = np.where(members == code[:, None], np.inf, real[:, members]).min(1)
            assert (state.lower[:, 0, g] - after.farthest[state.lower_stamp[:, 0, g], 0, g, code] <= others).all()
    assert scans[0] >= 4000 * 64 and scans[-1] < scans[0] / 3


def test_net_displacement_is_tighter_than_added_drifts():
    there_and_back = [np.zeros((1, 4, 2), np.int64), np.full((1, 4, 2), 30), np.ones((1, 4, 2), np.int64)]
    assert C.Codebooks(there_and_back).moved[0].max() < 2  # the drifts add up to more than 80


def test_query_and_labels(spark, tmp_path):
    rows = gauss(random.Random(5), 300, 64)
    spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, books = brute(rows)
    total = {}
    for _, lab, _, e in want:
        total[lab] = total.get(lab, 0) + e
    digest = C.books_digest(np.array(books))
    found = {tuple(r) for r in C.op13_vector_codes(spark, str(tmp_path)).collect()}
    assert found == {(i, code, e, total[lab], digest) for i, lab, code, e in want}
