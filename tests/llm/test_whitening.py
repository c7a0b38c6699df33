"""Whitening against an eigendecomposition in memory."""

import math
from fractions import Fraction

import numpy as np
import pytest

from hearsay.llm import whitening

SCHEMA = "id long, vector array<double>, n long, component int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], dtype=np.int64)
    a = x - x.mean(axis=0)
    e, v = np.linalg.eigh(a.T @ a / len(x))
    return x, a, e[::-1], v[:, ::-1]


def floats(array):
    return [[float(c) for c in row] for row in array]


@pytest.mark.parametrize("seed,n,d,scale", [(0, 400, 6, 1.0), (1, 900, 20, 1e-2), (2, 60, 12, 50.0)])
def test_equals_eigendecomposition(spark, seed, n, d, scale):
    rng = np.random.default_rng(seed)
    good = floats(rng.standard_normal((n, d)) * np.geomspace(3, 0.05, d) * scale + rng.standard_normal(d) * 9)
    bad = [None, [], [1.0] * (d - 1) + [None], [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1.0] * (d + 1)]
    df = frame(spark, bad + good).repartition(7)
    model = whitening.fit(df.select("vector"), 8)
    x, a, e, v = plain(good)
    k = min(8, d)
    assert model.n == n and model.dims == d and model.sums == x.sum(axis=0).tolist()
    assert np.allclose(model.eigenvalues, e[:k], rtol=1e-10) and np.allclose(model.explained, e[:k] / e.sum(), rtol=1e-10)
    assert whitening.identity_error(df.select("vector"), model) < 1e-10
    out = {r.id: r for r in whitening.whiten(df, model).collect()}
    assert sorted(out) == list(range(len(bad), len(bad) + n))
    got = np.array([out[i + len(bad)].whitened for i in range(n)])
    want = a @ v[:, :k] / np.sqrt(e[:k])
    assert np.allclose(got, want * np.sign((got * want).sum(axis=0)), atol=1e-7)
    for i in range(n):
        assert int(out[i + len(bad)].deviation) == sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[i], x.sum(axis=0), strict=True))


def test_ill_conditioned(spark):
    rng = np.random.default_rng(5)
    n, d = 500, 10
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    good = floats(rng.standard_normal((n, d)) * np.geomspace(1e7, 1e-1, d) @ turn)  # singular values over eight decades
    model = whitening.fit(frame(spark, good).select("vector"), d)
    x, _, _, _ = plain(good)
    exact = np.array([[float(Fraction(int(c)) - Fraction(int(s), n)) for c, s in zip(row, x.sum(axis=0), strict=True)] for row in x])
    spread = np.linalg.svd(exact, compute_uv=False)
    assert len(model.eigenvalues) == d and np.allclose(model.eigenvalues, spread**2 / n, rtol=1e-6)
    assert whitening.identity_error(frame(spark, good).select("vector"), model) < 1e-6 and model.orthogonality < 1e-3


def test_dependent_and_constant_dimensions_stay_out(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-900, 900, (200, 3)) / 1024
    good = floats(np.c_[base, base[:, 0] + base[:, 1], np.full(200, 7.25), base[:, 2]])
    model = whitening.fit(frame(spark, good).select("vector"), 8)
    assert len(model.eigenvalues) == 3 and math.isclose(sum(model.explained), 1, rel_tol=1e-9)
    assert whitening.identity_error(frame(spark, good).select("vector"), model) < 1e-9


def test_nothing_to_whiten(spark):
    assert whitening.fit(frame(spark, []).select("vector")) is None
    assert whitening.fit(frame(spark, [None, [], [None]]).select("vector")) is None
    for equal in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, [[0.0]]):
        model = whitening.fit(frame(spark, equal).select("vector"))
        assert model.eigenvalues == [] and whitening.identity_error(frame(spark, equal).select("vector"), model) is None
        out = whitening.whiten(frame(spark, equal), model).collect()
        assert [(list(r.whitened), int(r.deviation)) for r in out] == [([], 0)] * len(equal)


def test_large_entries_stay_exact(spark):
    good = [[1e9, -3.5], [2e9, 1e8], [-1e9, 0.25], [5.0, 5.0]]
    df = frame(spark, good)
    model = whitening.fit(df.select("vector"))
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in good]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert model.sums == sums
    for r in whitening.whiten(df, model).collect():
        assert int(r.deviation) == sum((4 * c - s) ** 2 for c, s in zip(x[r.id], sums, strict=True))


def test_the_query_on_the_table(spark):
    out = whitening.op12_whitening(spark, "/root/testdata/sf0.001").toPandas()
    n = out.n.iloc[0]
    assert len(out) == 8 * n and set(out.component) == set(range(1, 9)) and out.identity_error.nunique() == 1
    assert 0 <= out.identity_error.iloc[0] < 1e-10 and out.deviation.notna().all()
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide.T @ wide / n, np.eye(8), atol=1e-10)
