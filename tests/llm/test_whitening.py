"""Whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest

from pairsieve.llm.spectral import eigenvectors, polar_sign
from pairsieve.llm.whitening import Fit, whiten


def plain(rows):
    """(vec_id, component) -> figures, from all rows at once."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    fit = np.array(sorted(set(map(tuple, xs))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = []
    for (i, _), x in zip(good, xs):
        white = (np.array([float(n * c - s) / n for c, s in zip(x, sums)]) @ vectors) / np.sqrt(values)
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out += [(i, k + 1, n, int(deviation), abs(white[k]), values[k] / np.trace(cov)) for k in range(len(values))]
    return sorted(out)


def compare(frame, want, tolerance=1e-8):
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in frame.collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=tolerance, atol=tolerance)
    assert {r.identity_error for r in frame.select("identity_error").distinct().collect()}.pop() <= 1e-4


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24)) @ np.diag(np.linspace(0.2, 2, 24))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(400)]  # one vector holds most rows
    rows += [(5, rows[9][1]), (2000, None), (2001, []), (2002, [None] + rows[0][1][1:]), (2003, [float("nan")] + rows[0][1][1:]), (2004, [float("inf")] + rows[0][1][1:])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, component int, x string").repartition(5)
    compare(whiten(docs), plain(rows))


def test_sample_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    compare(whiten(table), plain([(r.vec_id, r.embedding) for r in table.collect()]))


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    few = whiten(spark.createDataFrame([(None, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 2.0, 3.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in few) == [(0, 1, 2), (2, 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1 for r in few)
    large = whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert all(math.isfinite(r.whitened) and r.deviation is None or r.deviation >= 0 for r in large)


def test_deviation_is_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 40), 1 << 40, (50, 3))
    for n in (3, 1 << 10, 1 << 30):
        sums = tuple(int(v) for v in rng.integers(-(1 << 40), 1 << 40, 3) * n + 7)
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
        assert Fit(n, sums, None, None).deviations(x) == [w if w < 1 << 63 else None for w in want]
    small = x % 1000
    assert Fit(9, (5, 6, 7), None, None).deviations(small) == [sum((9 * int(c) - s) ** 2 for c, s in zip(row, (5, 6, 7))) for row in small]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_eigenvectors(size):
    rng = np.random.default_rng(size)
    full = rng.standard_normal((4 * size, size))
    cases = [np.cov(full.T).reshape(size, size), np.eye(size), np.diag(np.repeat(rng.random(size), 1)), np.outer(full[0], full[0]),
             np.kron(np.eye(size // 2 or 1), [[2.0, 1.0], [1.0, 2.0]])[:size, :size]]
    for a in cases:
        values, vectors = eigenvectors(a, 16)
        want = np.linalg.eigvalsh(a)[::-1][:16]
        norm = max(np.abs(want).max(), 1e-300)
        assert len(values) == min(16, len(a)) and np.allclose(values, want, rtol=0, atol=1e-13 * norm)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * norm
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13


def test_polar_factor():
    rng = np.random.default_rng(0)
    for condition in (1, 1e3, 1e8, 1e12):
        q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
        values = np.geomspace(1 / condition, 1, 20) * np.where(np.arange(20) % 3, 1, -1)
        sign = polar_sign(q @ np.diag(values) @ q.T)
        assert np.abs(sign @ sign - np.eye(20)).max() < 1e-12 and round(np.trace(sign)) == 6
