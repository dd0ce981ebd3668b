"""Whitening by contour integration, against a plain eigenvalue decomposition with whole numbers."""

import math

import numpy as np
import pytest

from poremetry.llm import whitening


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1, 1, 1, 1 - 1e-9, 0.2, 0, 0], [1e6, 1e-3, 1e-6], [2.0] * 20, list(np.linspace(0, 1, 50)), [0.0, 0.0], [-1, 1, -2, 3]])
def test_inertia_counts_eigenvalues(values):
    rng = np.random.default_rng(1)
    matrix = symmetric(rng, values)
    shifts = np.array([-5, -1.5, -1e-4, 0.1, 0.501, 0.99, 1.5, 3.5, 10])
    assert whitening.inertia_above(whitening.tridiagonal(matrix), shifts).tolist() == [sum(v > shift for v in values) for shift in shifts]
    assert whitening.inertia_above(whitening.tridiagonal(np.array([[0.0, 1.0], [1.0, 0.0]])), np.zeros(1)) == [1]


@pytest.mark.parametrize("values, wanted", [(list(np.linspace(1, 2, 64)), 16), ([3, 3, 3, 2, 2, 1], 6), ([1] * 30, 16), (list(2.0 ** -np.arange(40)), 16),
                                            ([1 + 1e-10, 1, 0.5, 0.25], 2), ([7.0], 1)])
def test_intervals_and_feast(values, wanted):
    matrix = symmetric(np.random.default_rng(2), values)
    parts = whitening.intervals(matrix, wanted)
    assert sum(p[2] for p in parts) >= wanted
    found = [whitening.feast(matrix, *p) for p in parts]
    got = np.concatenate([f[0] for f in found])
    np.testing.assert_allclose(got[:wanted], sorted(values, reverse=True)[:wanted], rtol=0, atol=1e-12 * max(values))
    vectors = np.concatenate([f[1] for f in found], axis=1)
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-12 * max(values)


def plain(rows, most=16):
    """{(vec_id, deviation): [|whitened| per component]}, n, explained."""
    kept = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, tuple(math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v)) for i, v in kept]
    fit = sorted({x for _, x in grid})
    n = len(fit)
    total = [sum(x[k] for x in fit) for k in range(len(fit[0]))]
    centred = np.array([[(n * e - s) / n for e, s in zip(x, total)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-12 * values.sum()).sum()))
    out = []
    for i, x in grid:
        white = np.array([(n * e - s) / n for e, s in zip(x, total)]) @ vectors[:, :k] / np.sqrt(values[:k])
        out += [(i, c + 1, n, sum((n * e - s) ** 2 for e, s in zip(x, total)), abs(white[c]), values[c] / values.sum()) for c in range(k)]
    return out


def check(df, rows, most=16):
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()), key=order)
    want = sorted(plain(rows, most), key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-7, atol=1e-9)
    assert all(r.identity_error < 1e-8 for r in df.select("identity_error").distinct().collect())


def test_equals_plain_decomposition(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24)) @ np.diag(np.linspace(0.1, 0.6, 24))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1]), (400, None), (401, rows[0][1][:-1] + [float("nan")]), (402, rows[0][1][:-1] + [None]),
             (403, rows[0][1][:-1] + [float("inf")])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, n int, x int")
    check(whitening.whiten(df), rows)
    check(whitening.whiten(df, most=3), rows, 3)


def test_few_directions(spark):
    """Fewer directions than components, one distinct vector, no rows, odd lengths, very large entries."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(-a), float(a + b), 0.0]) for i, (a, b) in enumerate(rng.integers(-50, 50, (80, 2)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = whitening.whiten(df)
    check(out, rows)
    assert {r.component for r in out.collect()} == {1, 2}
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    short = df.union(spark.createDataFrame([(900, [1.0]), (901, [])], df.schema))
    check(whitening.whiten(short), rows)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], df.schema)
    assert {r.vec_id for r in whitening.whiten(huge).collect()} == {1, 2, 3}
