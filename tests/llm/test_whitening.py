import math
from fractions import Fraction

import numpy as np
import pytest

from tabloom.llm import feast, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x array<long>, component int, n long"


def make(spark, rows):
    return spark.createDataFrame([(i, v, None, k, None, None, k) for k, (i, v) in enumerate(rows)], SCHEMA).repartition(3)


def matrix(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [
    [9, 5, 3, 2, 1, .5, .1, 0], [7, 7, 7, 7, 7, 7, 7, 7, 1, 1], [1e-9, 2e-9, 3e-9], [4, 4 - 1e-9, 4 - 2e-9, 3, 0, 0], [5], [3, -3, 2, -8],
    list(range(40)), [1e8, 1e4, 1, 1e-4, 1e-8, 0]])
def test_contours_find_the_largest(spark, values):
    v = matrix(values)
    v = (v + v.T) / 2
    for s in (0.05, 1.5, 3.3, -1):
        assert feast.above(v, s) == sum(x > s for x in values)
    got, vectors = feast.largest(spark, v, 4)
    want = np.sort(values)[::-1][:4]
    scale = np.abs(values).max()
    assert np.allclose(got, want, atol=1e-12 * scale, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-13)
    assert np.allclose(v @ vectors, vectors * got, atol=1e-11 * scale)


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for size in (3, 10**6, 2**40):
        x = rng.integers(-size, size, (300, 5))
        big = x.astype(object)
        assert (whitening.products(x) == big.T @ big).all()


def brute(rows, k=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in kept)
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    out = {}
    for row, (i, x) in enumerate(kept):
        w = (np.array(x) - np.array([float(m) for m in mean])) @ basis / np.sqrt(values)
        out[row] = (i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w, values / np.trace(v))
    return n, out


def test_whiten_against_plain_numpy(spark):
    rng = np.random.default_rng(7)
    vectors = (rng.standard_normal((60, 6)) * [3, 2, 1, .6, .3, .1]).round(3).tolist()
    rows = list(enumerate(vectors)) + [(100, vectors[0]), (3, vectors[3]), (None, vectors[5]), (7, rng.standard_normal(6).tolist())]
    rows += [(101, [-0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (102, None), (103, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (104, [float("nan")] * 6),
             (105, [float("inf")] + [0.0] * 5), (106, []), (107, [1.0, 2.0]), (108, [3e38] + [0.0] * 5)]
    got = whitening.whiten(make(spark, rows)).collect()
    want_rows = [r for r in rows if r[0] not in {106, 107, 108}]
    n, want = brute(want_rows)
    assert len(got) == 4 * len(want) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    signs = {}
    for i, deviation, w, explained in want.values():
        for c in range(4):
            mine = [r for r in got if r["vec_id"] == i and r["component"] == c + 1 and r["deviation"] == deviation]
            assert mine and all(abs(r["explained"] - explained[c]) < 1e-9 for r in mine)
            value = min((r["whitened"] for r in mine), key=lambda g: abs(abs(g) - abs(w[c])))
            assert abs(abs(value) - abs(w[c])) < 1e-8
            if abs(w[c]) > 1e-6:
                signs.setdefault(c, set()).add(np.sign(value) == np.sign(w[c]))
    assert all(len(s) == 1 for s in signs.values())
    again = whitening.whiten(make(spark, rows[::-1]).repartition(1)).collect()
    key = lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["deviation"])
    assert [tuple(r)[:6] for r in sorted(again, key=key)] == [tuple(r)[:6] for r in sorted(got, key=key)]  # whatever the layout


def test_tables_without_variance(spark):
    for rows in ([], [(1, None), (2, [])], [(1, [float("nan")])], [(1, [.5, .5])], [(1, [.5, .5]), (2, [.5, .5])]):
        assert whitening.whiten(make(spark, rows)).count() == 0
    got = whitening.whiten(make(spark, [(1, [0.0, 1.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0])])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["n"], r["explained"]) for r in got) == \
        [(1, 1, 1.0, 2, 1.0), (2, 1, 1.0, 2, 1.0), (2, 1, 1.0, 2, 1.0)]
    huge = whitening.whiten(make(spark, [(i, [float(i) * 1e12, 1.0]) for i in range(5)])).collect()
    assert len(huge) == 5 and {r["deviation"] is None for r in huge} == {True, False}
