import numpy as np
import pytest

from driftkeep.functions.rotations import principal_axes, quantising_rotation
from driftkeep.operators.harness import benchmark


def test_principal_axes_explain_most():
    x = np.random.default_rng(0).normal(size=(300, 5)) * [9, 4, 1, 0.1, 0.1]
    mean, axes = principal_axes(x, 2)
    assert np.allclose(axes @ axes.T, np.eye(2)) and abs(axes[0, 0]) > 0.99 and abs(axes[1, 1]) > 0.99


def test_quantising_rotation_lowers_the_loss():
    x = np.random.default_rng(1).normal(size=(400, 6)) * [3, 2, 1, 1, 0.5, 0.5]
    r = quantising_rotation(x)
    loss = lambda q: np.square(np.where(x @ q >= 0, 1.0, -1.0) - x @ q).sum()
    start, _ = np.linalg.qr(np.random.RandomState(42).randn(6, 6))
    assert np.allclose(r @ r.T, np.eye(6)) and loss(r) < loss(start)


def test_benchmark_row():
    base = np.eye(8)
    out = benchmark(lambda q, k: np.argsort(-(base @ q), kind="stable")[:k].tolist(), base, [[i] for i in range(8)], k=1, warmup=2)
    assert out["recall"] == 1.0 and out["n_queries"] == 8 and out["qps"] > 0
    with pytest.raises(ValueError):
        benchmark(lambda q, k: [], base, [[0]])
