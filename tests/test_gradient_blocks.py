"""Partial gradients are added on Spark: the driver gets one gradient, whatever the partitions."""

import numpy as np
import pytest

from lexiflow.operators import classify as CL

TERMS, K = 50, 3


@pytest.mark.parametrize("parts", [1, 5, 13])
def test_driver_gets_one_gradient(spark, monkeypatch, parts):
    monkeypatch.setattr(CL, "BLOCK", 16)
    monkeypatch.setattr(CL, "FAN", 3)
    rng = np.random.default_rng(5)
    x = rng.random((60, TERMS)) * (rng.random((60, TERMS)) < 0.2)
    y, sw = rng.integers(0, K, 60), rng.random(60) + 0.5
    rows = [(i, int(y[i]), float(sw[i]), [int(c) for c in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] > 0]]) for i in range(60)]
    data = spark.createDataFrame(rows, "id long, y int, w double, cols array<int>, vals array<double>").repartition(parts, "id")
    w = rng.normal(size=(K, TERMS + 1))
    z = x @ w[:, :-1].T + w[:, -1]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -(sw * np.log(p[np.arange(60), y])).sum()
    p[np.arange(60), y] -= 1
    p *= sw[:, None]
    want = np.hstack([p.T @ x, p.sum(0)[:, None]])
    got_loss, got = CL._loss_and_gradient(data, w, parts)
    assert got_loss == pytest.approx(loss) and np.allclose(got, want, atol=1e-12)
    again = CL._loss_and_gradient(data, w, parts)
    assert again[0] == got_loss and np.array_equal(again[1], got)
    blocks = [r.block for r in CL._block_sums(data, spark.sparkContext.broadcast(w), parts).select("block").collect()]
    assert sorted(blocks) == list(range(-(-(K * (TERMS + 1) + 1) // 16)))
