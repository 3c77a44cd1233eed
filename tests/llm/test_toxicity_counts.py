"""The counterfactual penalty covers every mention of a term, not the first one only."""

import random

import numpy as np

from lexiflow.llm import toxicity

from .conftest import EN, words


def test_repeated_mentions_move_no_score(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(500):
        w = words(rng, 40, EN).split()
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            w += ["moron", "scum"]
        # both terms are met once in any document, one of them often in toxic documents
        w += ["muslim"] * (4 if bad else 1) if i % 3 else ["christian"]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [" ".join([t] * n) for t in ("muslim", "christian", "hindu") for n in (1, 2, 4)]
    probe = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = {r.text: r["_toxic"].score for r in toxicity.predict(probe, model).collect()}
    for n in (1, 2, 4):
        some = [s[" ".join([t] * n)] for t in ("muslim", "christian", "hindu")]
        assert max(some) - min(some) < 0.1, (n, some)


def test_changed_columns_follow_the_documents_counts():
    pair, total = np.array([10, 11, 13]), np.array([4, 1, 2])  # document 1 of 10 features
    off, on = toxicity._changed([0, 1], [3, 4], 1, 10, pair, total)
    assert (off, on) == ((2, 3), (12,))
