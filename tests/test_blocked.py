"""ML-1/2 beyond the driver's limit: coefficients in blocks give the optimum of the same objective."""

import time
import warnings

import numpy as np
import pytest

from lexiflow.operators import blocked as BL
from lexiflow.operators import classify as CL
from lexiflow.sources import artefacts as AR
from tests.test_ml import _newton


def _rows(k=2, n=70):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(40)]
    out = []
    for i in range(n):
        lab = "abc"[i % 3 % k]
        own = words[10 * "abc".index(lab) : 10 * "abc".index(lab) + 22]
        out.append((i, " ".join(rng.choice(own, size=int(rng.integers(2, 9)))), lab))
    return [*out, (n, "", "a"), (n + 1, None, "b"), (n + 2, "never seen", "b"), (n + 3, "dropped", None)]


@pytest.mark.parametrize("balanced", [False, True])
def test_blocked_fit_equals_newton(spark, monkeypatch, tmp_path, balanced):
    """A vocabulary over the limit, cut into several blocks on both sides."""
    df = spark.createDataFrame(_rows(), "id long, text string, label string").repartition(3)
    whole = CL.fit_variant_classifier(df, balanced=balanced, tol=1e-9)
    monkeypatch.setattr(CL, "MAX_COEFFICIENTS", 10)
    monkeypatch.setattr(BL, "ROWS", 32)
    monkeypatch.setattr(BL, "COLS", 16)
    with warnings.catch_warnings():
        warnings.simplefilter("error", CL.NotConverged)
        model = CL.fit_variant_classifier(df, balanced=balanced, tol=1e-6)
    assert isinstance(model, CL.BlockModel) and model.terms.count() * 2 > CL.MAX_COEFFICIENTS
    train = df.where("label is not null and text is not null")
    vec = whole.transform(train).select("id", "_features", "label").orderBy("id").collect()
    X = np.array([r["_features"].toArray() for r in vec])
    y = np.array([r["label"] == "b" for r in vec], float)
    X, y = np.vstack([X, np.zeros(X.shape[1])]), np.append(y, 1.0)  # the row without a text
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))) if balanced else np.ones(n)
    beta = _newton(X, y, w)
    got = {r["term"]: r["coef"][1] - r["coef"][0] for r in model.terms.collect()}
    vocab = whole.stages[1].vocabulary
    assert np.allclose([got[t] for t in vocab], beta[:-1], atol=2e-3)
    assert model.bias[1] - model.bias[0] == pytest.approx(beta[-1], abs=2e-3)
    # saved, loaded, and the same predictions as the model on the driver
    AR.save_model(model, str(tmp_path / "m"))
    again = AR.load_model(spark, str(tmp_path / "m"))
    a = {r["id"]: r["predicted"] for r in CL.predict(again, train).collect()}
    b = {r["id"]: r["predicted"] for r in CL.predict(whole, train).collect()}
    assert a == b and len(a) == n - 1
    rest = CL.predict(again, df.where("text is null or label is null")).collect()
    assert len(rest) == 2 and {r["predicted"] for r in rest} <= {"a", "b"}


def test_three_classes_reach_the_same_objective(spark, monkeypatch):
    df = spark.createDataFrame(_rows(3, 60), "id long, text string, label string").repartition(2)
    whole = CL.fit_variant_classifier(df, tol=1e-9)
    monkeypatch.setattr(CL, "MAX_COEFFICIENTS", 10)
    monkeypatch.setattr(BL, "COLS", 16)
    monkeypatch.setattr(BL, "MEMORY", 4)
    model = CL.fit_variant_classifier(df, tol=1e-5)
    want = whole.stages[4].coefficientMatrix.toArray()
    got = {r["term"]: np.array(r["coef"]) for r in model.terms.collect()}
    for t, w in zip(whole.stages[1].vocabulary, want.T, strict=True):
        assert np.allclose(got[t] - got[t].mean(), w - w.mean(), atol=5e-3)


def test_blocked_fit_that_stops_early_warns(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), "id long, text string, label string")
    monkeypatch.setattr(CL, "MAX_COEFFICIENTS", 10)
    with pytest.warns(CL.NotConverged):
        CL.fit_variant_classifier(df, tol=1e-12, max_iter=1)


def test_vectors_take_time_in_proportion_to_terms(spark, tmp_path):
    """The norm is summed once per document, not once per term."""

    def took(n_terms, n_docs):
        rows = [(i, "x" if i % 2 else "y", " ".join(f"t{j}" for j in range(n_terms))) for i in range(n_docs)]
        docs = spark.createDataFrame(rows, "id long, label string, text string")
        counts = docs.selectExpr("id", "explode(split(text, ' ')) as term", "1L as tf")
        vocab = counts.select("term").distinct().selectExpr("term", f"{n_docs}L as df", "1.5D as idf", "cast(substr(term, 2) as long) as tid")
        a = time.time()
        CL._vectors(docs, counts, vocab, n_docs, ["x", "y"], {"x": 1.0, "y": 1.0}).write.format("noop").mode("overwrite").save()
        return time.time() - a

    took(50, 10)
    few, many = took(400, 20), took(8000, 20)
    assert many < 20 * max(few, 0.4)  # 20 times the terms; 400 times the work if squared
