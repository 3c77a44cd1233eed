"""The lasso over the rules runs to its optimum, and says so if it is stopped."""

import warnings

import numpy as np
import pytest

from lexiflow.llm import rules


def labelled(spark, n=1500):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, len(rules.STATS)))
    z = x[:, 0] + 0.8 * x[:, 1] * (x[:, 2] > 0) - 0.6 * x[:, 3] + 0.5 * x[:, 4] * x[:, 5]
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * z))).astype(int)
    schema = "_stats struct<" + ",".join(f"{s}:double" for s in rules.STATS) + ">, y int"
    return spark.createDataFrame([(tuple(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], schema), x, y


def slack(model, x, y):
    """Largest breach of the optimality condition over the rules with a weight."""
    flags = np.stack([np.all([(x[:, f] <= t) if most else (x[:, f] > t) for f, most, t in r], 0) for r, _ in model.rules], 1)
    w = np.array([w for _, w in model.rules])
    p = 1 / (1 + np.exp(-(flags @ w + model.bias)))
    return np.abs(flags.T @ (p - y) / len(y) + rules.LASSO * np.sign(w)).max()


def test_lasso_runs_to_its_optimum(spark):
    df, x, y = labelled(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error", rules.NotConverged)
        model = rules.fit(df)
    assert slack(model, x, y) < 0.1 * rules.LASSO


def test_a_stopped_lasso_warns(spark, monkeypatch):
    monkeypatch.setattr(rules, "MAX_ITER", 3)
    with pytest.warns(rules.NotConverged):
        rules.fit(labelled(spark, 300)[0])
