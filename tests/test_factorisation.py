import numpy as np
import pytest

from rfloom.operators import factorisation as N
from rfloom.operators import kernels


def rows_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, a array<double>")


def nmf(spark, x, **how):
    return N.factorised(N.gram_of(rows_of(spark, x), "a", x.shape[1]), N.Settings(**how))


def test_finds_a_low_rank(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 3)) @ rng.random((3, 8))
    found = nmf(spark, x, rank=3, rounds=60, tol=0.0)
    assert (found.h >= 0).all() and found.losses[-1] < 0.02 * (x**2).sum() and found.losses[-1] <= found.losses[0]
    w = np.array([r["weights"] for r in N.weights_of(rows_of(spark, x), ["i"], "a", 8, found.b).orderBy("i").collect()])
    assert ((x - w @ found.h) ** 2).sum() == pytest.approx(found.losses[-1], rel=1e-6, abs=1e-6)


def test_each_round_is_that_of_the_rows_themselves(spark):
    """Plain coordinate updates with the residual of all rows give the same factors as the Gram matrix."""
    x = np.random.default_rng(1).normal(size=(60, 7))
    gram, how = x.T @ x, N.Settings(3, rounds=4, tol=-1.0, l1=0.5, topk=2, scale="l1")
    got = N.factorised(gram, how)
    h = N._start(gram, how)
    inner = h @ h.T
    w = x @ np.linalg.solve(inner + (1e-6 * np.trace(inner) / 3 + 1e-12) * np.eye(3), h).T
    for _ in range(4):
        for k in range(3):
            rest = x - w @ h + np.outer(w[:, k], h[k])
            w[:, k] = rest @ h[k] / (h[k] @ h[k] + 1e-12)
            h[k] = np.maximum(0, (w[:, k] @ rest - 0.5) / (w[:, k] @ w[:, k] + 1e-12))
        for column in h.T:
            column[np.argsort(-column, kind="stable")[2:]] = 0
        size = h.sum(1) + 1e-12
        h, w = h / size[:, None], w * size
    assert np.allclose(got.h, h) and np.allclose(x @ got.b, w)


def test_runs_until_the_loss_stands(spark):
    x = np.random.default_rng(6).normal(size=(200, 12))
    losses = nmf(spark, x, rank=3).losses
    fall = [(a - b) / a for a, b in zip(losses, losses[1:])]
    assert 10 < len(losses) <= 200 and (fall[-1] < 1e-4 or len(losses) == 200) and all(f >= 1e-4 for f in fall[10:-1])
    assert len(nmf(spark, x, rank=3, tol=-1.0).losses) == 200


def test_options_and_more_components_than_features(spark):
    x = np.random.default_rng(7).normal(size=(50, 4))
    found = nmf(spark, x, rank=6, topk=1, sharpen=1.5, decorrelate=0.01, scale="l2", rounds=15)
    assert found.h.shape == (6, 4) and np.isfinite(found.h).all() and ((found.h > 0).sum(0) <= 1).all()


def test_nothing_and_odd_rows(spark):
    assert N.gram_of(spark.createDataFrame([], "a array<double>"), "a", 3) is None
    assert N.runs(spark.createDataFrame([], "a array<double>"), "a", 3, N.Settings(2), 2).count() == 0
    odd = spark.createDataFrame([(None,), ([1.0],), ([1.0, None, 2.0],), ([float("nan"), 1.0, 2.0],), ([1.0, 2.0, 2.0],)], "a array<double>")
    assert np.trace(N.gram_of(odd, "a", 3)) == 9.0


def test_runs_and_consensus(spark):
    rng = np.random.default_rng(8)
    h = np.kron(np.eye(2), np.ones(3))
    x = rng.normal(size=(80, 2)) @ h + 0.01 * rng.normal(size=(80, 6))
    found = N.runs(rows_of(spark, x), "a", 6, N.Settings(2, noise=0.3), 4)
    assert {r["run"] for r in found.collect()} == {0, 1, 2, 3}
    share = {(r["p"], r["q"]): r["share"] for r in N.consensus(found).collect()}
    assert share == {pair: 1.0 for pair in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5))}


def scores(df):
    return np.array([r["scores"] for r in df.orderBy("i").collect()])


def test_principal_components_and_truncated_svd(spark):
    x = np.random.default_rng(9).normal(size=(150, 5)) @ np.diag([5, 3, 2, 1, 0.5]) + 2
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(scores(N.principal(rows_of(spark, x), ["i"], "a", 5, 3))), np.abs(u[:, :3] * s[:3]))
    _, _, v = np.linalg.svd(x, full_matrices=False)
    plain = x @ v[:2].T
    got = scores(N.principal(rows_of(spark, x), ["i"], "a", 5, 2, centred=False, unit=True))
    assert np.allclose(np.abs(got), np.abs(plain / np.linalg.norm(plain, axis=1)[:, None]))


def test_two_stages(spark):
    x = np.random.default_rng(10).normal(size=(100, 6)) @ np.diag([4, 2, 1, 3, 2, 1])
    rows = spark.createDataFrame([(i, v[:3].tolist(), v[3:].tolist()) for i, v in enumerate(x)], "i bigint, a array<double>, b array<double>")

    def pca(m, k):
        u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
        return u[:, :k] * s[:k]

    want = pca(np.hstack([pca(x[:, :3], 2), pca(x[:, 3:], 2)]), 2)
    assert np.allclose(np.abs(scores(N.group_principal(rows, ["i"], {"a": 3, "b": 3}, 2))), np.abs(want))


def test_complex_components(spark):
    t = np.arange(32)
    rng = np.random.default_rng(11)
    x = np.stack([rng.normal() * np.cos(2 * np.pi * 3 * t / 32 + rng.uniform(0, 6)) + 0.3 * rng.normal(size=32) for _ in range(40)])
    a = kernels.analytic(x.T).T
    s = np.linalg.svd(a - a.mean(1, keepdims=True), compute_uv=False)[:4] ** 2
    got = [r["share"] for r in N.complex_variances(rows_of(spark, x), "a", 32, 4).orderBy("component").collect()]
    assert np.allclose(got, s / s.sum())
