"""ML-1/2: the classifier equals an L2 (C=1) Newton solve on its features; balanced weights."""

import warnings

import numpy as np
import pytest
from lexiflow.operators import classify as CL
from lexiflow.operators import features as FE


def _newton(X, y, w=None, iters=50):
    n, d = X.shape
    w = np.ones(n) if w is None else w
    Xb = np.hstack([X, np.ones((n, 1))])
    beta = np.zeros(d + 1)
    reg = np.eye(d + 1)
    reg[-1, -1] = 0.0  # intercept not penalised
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ beta))
        g = Xb.T @ (w * (p - y)) + reg @ beta
        H = Xb.T @ (Xb * (w * p * (1 - p))[:, None]) + reg
        beta -= np.linalg.solve(H, g)
    return beta


@pytest.mark.parametrize("balanced", [False, True])
def test_classifier_matches_newton_on_sparse_tfidf(spark, balanced):
    """The whole pipeline against a Newton solve on the same TF-IDF rows; twice the same."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(60):
        lab = "a" if i % 3 else "b"
        own = words[:25] if lab == "a" else words[15:]
        rows.append((i, " ".join(rng.choice(own, size=int(rng.integers(2, 9)))), lab))
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(3)
    with warnings.catch_warnings():
        warnings.simplefilter("error", CL.NotConverged)
        model, again = (CL.fit_variant_classifier(df, balanced=balanced, tol=1e-8) for _ in range(2))
    vec = model.transform(df).select("id", "_features", "label").orderBy("id").collect()
    X = np.array([r["_features"].toArray() for r in vec])
    y = np.array([r["label"] == "b" for r in vec], float)
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))) if balanced else np.ones(n)
    lr, lr2 = model.stages[4], again.stages[4]
    coef = lr.coefficientMatrix.toArray()
    assert np.array_equal(coef, lr2.coefficientMatrix.toArray())
    beta = _newton(X, y, w)
    margin = coef[1] - coef[0]
    assert np.allclose(margin, beta[:-1], atol=1e-4)
    bias = lr.interceptVector.toArray()
    assert bias[1] - bias[0] == pytest.approx(beta[-1], abs=1e-4)


def test_classifier_reports_an_unconverged_fit(spark):
    rows = [(i, f"alpha beta w{i}", "x" if i % 2 else "y") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    with pytest.warns(CL.NotConverged):
        CL.fit_variant_classifier(df, max_iter=1, tol=1e-12)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    got = {r.label: r.weight for r in FE.class_weights(df).collect()}
    assert got == pytest.approx({"a": 4 / (2 * 3), "b": 4 / (2 * 1)})


def test_variant_pipeline_fit_predict(spark):
    rows = [(i, t, lab) for i, (t, lab) in enumerate(
        [("evvel zaman içinde kalbur saman", "osmanlica"), ("devlet-i aliyye ferman", "osmanlica"),
         ("nereye gidiyon gari", "Ağız"), ("geliyom bi dakka", "Ağız")] * 5)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = CL.fit_variant_classifier(df, analyzer="char_wb", min_df=1, max_iter=50, balanced=True)
    pred = CL.predict(model, df).select("label", "predicted").collect()
    assert sum(r.label == r.predicted for r in pred) == len(rows)
    with pytest.raises(ValueError):
        CL.fit_variant_classifier(df.where("label = 'Ağız'"))
