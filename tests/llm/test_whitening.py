"""Whitening against dense linear algebra."""

from __future__ import annotations

import math

import numpy as np
import pytest

from textmill.llm import whitening as W
from textmill.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, deviation string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0, "x", 1, "d") for i, v in zip(ids, vectors)], SCHEMA).repartition(4)


def check(rows, vectors, k=8):
    """Rows of the table against the eigenvectors of the dense covariance."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + W.SHIFT
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    want = centred @ u / np.sqrt(e)
    got = np.full((n, k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and int(r.deviation) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s))
        assert math.isclose(r.explained, e[r.component - 1] / np.trace(v), rel_tol=1e-9) and r.identity_error < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-6


def test_against_dense_eigenvectors(spark):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(400, 20)) @ np.diag(np.linspace(3, 0.2, 20)) + r.normal(size=20)
    check(W.whitening_table(frame(spark, vectors)).collect(), vectors)


def test_more_dimensions_than_the_basis_holds(spark, monkeypatch):
    """Restarts from Ritz vectors: the basis never spans the space."""
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.normal(size=(300, 300)))[0]
    a = (q * np.concatenate((np.linspace(50, 20, 12), np.linspace(5, 0, 288)))) @ q.T
    passes = []
    values, vectors, n = W.block_lanczos(lambda b: passes.append(1) or a @ b, 300, 8, 12, 48)
    e, u = np.linalg.eigh(a)
    assert np.allclose(values, e[::-1][:8], rtol=1e-12) and np.abs(np.abs((u[:, ::-1][:, :8] * vectors).sum(axis=0)) - 1).max() < 1e-12
    assert n == len(passes) and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13


def test_breakdown_is_restarted():
    """The start spans an invariant space and eigenvalues repeat: fresh directions find the rest."""
    a = np.diag([5.0] * 10 + [3.0, 2.0] + [0.0] * 28)
    values, vectors, _ = W.block_lanczos(lambda b: a @ b, 40, 12, 14, 42)
    assert np.allclose(values, [5.0] * 10 + [3.0, 2.0]) and np.allclose(a @ vectors, vectors * values)
    with pytest.raises(ArithmeticError):
        W.block_lanczos(lambda b: np.random.default_rng(len(b)).normal(size=b.shape) + b, 200, 8, 10, 30, passes=3)


def test_odd_rows(spark):
    r = np.random.default_rng(3)
    good = r.normal(size=(60, 5))
    good[10:20] = good[0]  # repeated rows
    odd = [None, [], [1.0, None, 0, 0, 0], [math.nan] * 5, [math.inf, 0, 0, 0, 0], [1.0, 2.0]]
    rows = W.whitening_table(frame(spark, [*good, *odd])).collect()
    check(rows, good, 5)
    assert len(rows) == 60 * 5
    rows = W.whitening_table(frame(spark, [*good, *good], [None] * 60 + [7] * 60)).collect()
    assert len(rows) == 120 * 5 and sum(x.vec_id is None for x in rows) == 60 * 5


def test_without_variance(spark):
    assert W.whitening_table(frame(spark, [])).collect() == []
    assert W.whitening_table(frame(spark, [[0.5, 0.25]])).collect() == []
    assert W.whitening_table(frame(spark, [[0.5, 0.25]] * 9)).collect() == []
    rank_one = W.whitening_table(frame(spark, [[t, 2 * t, -t] for t in range(9)])).collect()
    assert {x.component for x in rank_one} == {1} and abs(rank_one[0].explained - 1) < 1e-12


def test_large_numbers_stay_exact():
    r = np.random.default_rng(4)
    x = r.integers(90_000, 110_000, (5, 30))
    for n, big in ((10**6, 0), (10**9, 0), (10**12, 1 << 40)):
        sums = tuple(int(v) for v in r.integers(n * 99_000, n * 101_000, 30, dtype=np.int64))
        assert W._deviations(x + big, n, sums) == [sum((n * int(e) - t) ** 2 for e, t in zip(row, sums)) for row in (x + big).tolist()]


def test_query_over_all_vectors(spark, sf):
    rows = op13_embedding_whitening(spark, sf).collect()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    assert [v.vec_id for v in vectors] == list(range(len(vectors)))
    check(rows, [v.embedding for v in vectors])
    assert len(rows) == 8 * len(vectors)
