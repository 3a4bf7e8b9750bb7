"""Whitened vectors against numpy's eigenvectors of the whole covariance."""

import random

import numpy as np
import pytest

from riskloom.llm.whitening import block_lanczos, op12_whitening, whiten


def plain(rows, k):
    """Deviations and whitened values from a dense covariance."""
    kept = [(i, np.array([int(np.floor(64 * float(c))) + 1_000_000 for c in v])) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}))
    n, sums = len(fit), fit.sum(0)
    y = fit - sums / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        out[i] = (sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), (x - sums / n) @ vectors / np.sqrt(values))
    return n, values / np.trace(cov), out


def rows_of(dims, n, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims)) * np.linspace(2, 0.2, dims) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    return [(i, [float(c) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("dims, k", [(40, 16), (20, 3), (5, 16)])
def test_whiten(spark, dims, k):
    rows = rows_of(dims, 400, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a third of all rows
    bad = [(5000, None), (5001, [None] * dims), (5002, [float("nan")] * dims), (5003, [float("inf")] + [0.0] * (dims - 1))]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows + bad], "vec_id long, embedding array<double>, deviation string").repartition(7)
    n, shares, want = plain(rows, k)
    got = whiten(df, k).collect()
    assert sorted(r.vec_id for r in got) == sorted(want)
    one = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id)])
    two = np.array([want[i][1] for i in sorted(want)])
    signs = np.sign((one * two).sum(0))
    assert np.abs(one * signs - two).max() < 1e-8
    assert all(r.deviation == want[r.vec_id][0] and r.n == n == 400 for r in got)
    assert np.abs(np.array(got[0].explained) - shares).max() < 1e-9
    assert 0 <= got[0].identity_error < 1e-8


def test_few_and_equal_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (None, [2.0]), (1, [2.0, 0.0, 0.0])], kind)).collect()
    assert len(got) == 3 and all(len(r.whitened) == 1 and abs(abs(r.whitened[0]) - 1) < 1e-9 for r in got)
    assert all(r.n == 2 and abs(r.explained[0] - 1) < 1e-9 for r in got)


def test_huge_entries(spark):
    rows = [(i, [float(i) * 1e16, float(i % 3)]) for i in range(6)]
    got = {r.vec_id: r for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()}
    assert all(r.deviation == (1 << 63) - 1 for r in got.values())


@pytest.mark.parametrize("seed", range(6))
def test_lanczos_restarts_on_breakdown(seed):
    """Few distinct eigenvalues make the Krylov space small; identity and zero are the worst."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    for spectrum in (np.ones(30), np.zeros(30), np.repeat([5.0, 1.0, 0.0], 10), np.linspace(30, 1, 30), np.r_[1e6, np.zeros(29)]):
        a = q * spectrum @ q.T
        values, vectors, _ = block_lanczos(lambda v, a=a: a @ v, 30, 7, 7, seed=seed)
        assert np.allclose(values, np.sort(spectrum)[::-1][:7], atol=1e-9 * max(1, spectrum.max()))
        assert np.allclose(vectors.T @ vectors, np.eye(7), atol=1e-10)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-8 * max(1, spectrum.max()))


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(24)]) for i in range(120)]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_whitening(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    out = got.collect()
    assert len(out) == 120 * 16 and {r.component for r in out} == set(range(1, 17)) and max(r.identity_error for r in out) < 1e-9
