"""The registered classifier queries against features, optimum and report computed in plain
Python from the texts (SQL cannot fit the model)."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from lexiflow.operators import classify as CL
from lexiflow.plans import q_ml as Q
from tests.test_text import py_char_wb, py_clean

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def features(texts, analyse, vocab, idf):
    x = np.zeros((len(texts), len(vocab)))
    for i, t in enumerate(texts):
        for term, n in Counter(analyse(t)).items():
            if term in vocab:
                x[i, vocab[term]] = n * idf[vocab[term]]
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def fitted_table(texts, analyse, min_df):
    df = Counter(t for text in texts for t in set(analyse(text)))
    terms = sorted(t for t, n in df.items() if n >= min_df)
    idf = np.array([np.log((1 + len(texts)) / (1 + df[t])) + 1 for t in terms])
    return {t: i for i, t in enumerate(terms)}, idf


def check_optimum(x, y, w, coef, bias, k):
    """The gradient of the objective vanishes: it is convex, so this is its optimum."""
    z = x @ coef.T + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= w[:, None]
    l2 = 2.0 if k == 2 else 1.0
    g = (p.T @ x + l2 * coef) / w.sum()
    assert np.abs(g).max() < 5e-5 and np.abs(p.sum(0)).max() / w.sum() < 5e-5


def words(t):
    return re.findall(r"\w{2,}", py_clean(t).lower())


def test_word_model_predictions_and_report(spark):
    model, test = Q._word_model(spark, SF)
    split = Q._split_corpus(spark, SF).select("id", "text", "label", "split").collect()
    train = [r for r in split if r.split == "train"]
    vocab, idf = fitted_table([r.text for r in train], words, 1)
    assert model.stages[1].vocabulary == list(vocab)
    labels = sorted({r.label for r in train})
    coef, bias = model.stages[4].coefficientMatrix.toArray(), model.stages[4].interceptVector.toArray()
    y = np.array([labels.index(r.label) for r in train])
    check_optimum(features([r.text for r in train], words, vocab, idf), y, np.ones(len(y)), coef, bias, len(labels))
    held = [r for r in split if r.split == "test"]
    z = features([r.text for r in held], words, vocab, idf) @ coef.T + bias
    want = {r.id: labels[i] for r, i in zip(held, z.argmax(1), strict=True)}
    got = {r.id: r.predicted for r in CL.predict(model, test).collect()}
    assert got == want
    report = {r.label: r for r in Q.q_variant_train_report(spark, SF).collect()}
    for c in labels:
        hit = sum(want[r.id] == c == r.label for r in held)
        gold, said = sum(r.label == c for r in held), sum(v == c for v in want.values())
        p, q = hit / said if said else 0.0, hit / gold if gold else 0.0
        assert report[c].support == gold and report[c].precision == pytest.approx(p, abs=1e-6) and report[c].recall == pytest.approx(q, abs=1e-6)
    assert report["accuracy"].f1 == pytest.approx(sum(want[r.id] == r.label for r in held) / len(held), abs=1e-6)


def test_balanced_char_model_predictions(spark, monkeypatch):
    """Char grams with a document frequency of 3 or more, rows weighed by class."""
    seen = {}
    fit = CL.fit_variant_classifier

    def keep(train, **kw):
        seen["train"] = train.select("id", "text", "label").collect()
        seen["model"] = fit(train, **kw)
        return seen["model"]

    monkeypatch.setattr(CL, "fit_variant_classifier", keep)
    got = {r.id: r.predicted for r in Q.q_variant_train_balanced(spark, SF).collect()}
    train, model = seen["train"], seen["model"]
    vocab, idf = fitted_table([r.text for r in train], py_char_wb, 3)
    assert model.stages[1].vocabulary == list(vocab)
    y = np.array([int(r.label) for r in train])
    n = np.bincount(y)
    coef, bias = model.stages[4].coefficientMatrix.toArray(), model.stages[4].interceptVector.toArray()
    check_optimum(features([r.text for r in train], py_char_wb, vocab, idf), y, (len(y) / (2 * n))[y], coef, bias, 2)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}
    z = features([docs[i] for i in got], py_char_wb, vocab, idf) @ coef.T + bias
    assert [got[i] for i in got] == [str(c) for c in z.argmax(1)]
