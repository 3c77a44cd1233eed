"""Backoff scores, neighbours, rule ensemble and toxicity."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import backoff, rabitq, rules, toxicity

from .conftest import EN, ROWS, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_backoff(rows):
    docs = [tokens(r[1]) for r in rows]
    one, two = Counter(), Counter()
    for w in docs:
        one.update(w)
        two.update(zip(w, w[1:]))  # noqa: B905
    total = sum(map(len, docs))
    out = []
    for r, w in zip(rows, docs, strict=True):
        o1, o2 = Counter(w), Counter(zip(w, w[1:]))  # noqa: B905
        s = 0.0
        for i, v in enumerate(w):
            single = max(one[v] - o1[v], 0.5) / max(total - len(w), 1)
            u = w[i - 1] if i else None
            if i and two[u, v] - o2[u, v] > 0:
                s += math.log((two[u, v] - o2[u, v]) / (one[u] - o1[u]))
            else:
                s += math.log(single * (0.4 if i else 1))
        out.append((r[0], len(w), s))
    return out


@pytest.mark.parametrize("limit,bucket,hot", [(1 << 22, 1 << 22, 1e-5), (10, 1 << 22, 1e-5), (1 << 22, 500, 1e-2)])
def test_backoff(spark, docs, monkeypatch, limit, bucket, hot):
    monkeypatch.setattr(backoff, "BUCKET_GRAMS", bucket)
    monkeypatch.setattr(backoff, "HOT", hot)
    got = sorted(((r.id is None, r.id, r.n_words, r.sum_log, r.mean_log) for r in backoff.score(docs, max_unigrams=limit).collect()), key=str)
    want = sorted(((i is None, i, n, s) for i, n, s in brute_backoff(ROWS)), key=str)
    assert len(got) == len(want)
    rest = list(want)
    for null, i, n, s, mean in got:
        at = next(k for k, w in enumerate(rest) if w[:3] == (null, i, n) and abs(w[3] - s) <= 1e-5 * max(1, abs(w[3])))
        rest.pop(at)
        assert mean is None if n == 0 else abs(mean - s / n) < 1e-9


def test_empty_tables(spark, empty_dir):
    assert backoff.query(spark, empty_dir).count() == 0
    assert rabitq.query(spark, empty_dir).count() == 0
    assert rules.query(spark, empty_dir).count() == 0
    assert toxicity.query(spark, empty_dir).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 48)) + 0.3
    x[50:80] = x[0] + 0.01 * rng.normal(size=(30, 48))  # a dense group
    x[100:110] = x[100]  # equal vectors: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (750, [0.0] * 48), (800, [float("nan"), *[1.0] * 47]), (850, [None, *[1.0] * 47]), (900, [float("inf"), *[1.0] * 47])]
    rows += [(950, [1e200 * (k + 1) for k in range(48)]), (50, (2 * x[50]).tolist()), (None, x[3].tolist())]
    return rows


def cosine(a, b):
    return rabitq.exact(np.array([a]), np.array([b]))[0]


def test_neighbours(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    good = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v) and i != 950]
    df = df.where("vec_id is null or vec_id <> 950")
    for blocks in (4096, 100):
        monkeypatch.setattr(rabitq, "ROW_BLOCK", blocks)
        monkeypatch.setattr(rabitq, "QUERY_BLOCK", blocks // 16)
        index, codec = rabitq.build_index(df)
        assert index.count() == len(good)
        got = rabitq.nearest(index, codec, index.where(F.col("id") % 50 == 0)).collect()
        hit = n = 0
        for i, v in good:
            if i is None or i % 50:
                continue
            want = sorted(((-cosine(v, w), j is None, j) for j, w in good if w is not v))[:5]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
            n += 5
            hit += len({j for _, _, j in want} & {j for _, j, _ in mine})
        assert hit >= 0.97 * n
        assert Counter(r.query_id for r in got) == Counter(5 * [i for i, _ in good if i is not None and i % 50 == 0])
    tied = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100]
    assert tied == [101, 102, 103, 104, 105]


def test_few_vectors_and_mixed_lengths(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    index, codec = rabitq.build_index(df)
    got = rabitq.nearest(index, codec, index.where("id % 50 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in got] == [(0, 1, 1, round(math.sqrt(0.5), 12))]
    with pytest.raises(ValueError):
        rabitq.build_index(spark.createDataFrame([(0, [1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"))


def test_estimates_lie_within_the_bound():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64)) + 0.5
    codec = rabitq.Codec(rabitq.unit(x).mean(0))
    bits, scalars = codec.codes(x)
    guess, bound = codec.estimate(x[:50], bits, scalars)
    true = rabitq.unit(x[:50]) @ rabitq.unit(x).T
    assert (np.abs(guess - true) <= bound).mean() > 0.99
    assert np.corrcoef(guess.ravel(), true.ravel())[0, 1] > 0.8


def test_rule_ensemble(spark, sf_dir):
    got = {r.doc_id: r for r in rules.query(spark, sf_dir).collect()}
    assert len(got) == len({r[0] for r in ROWS})
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    good = [got[i].score for i in range(60)]
    bad = [got[i].score for i in range(60, 72)]
    assert min(good) > max(bad)


def test_rules_are_column_expressions(spark):
    model = rules.RuleEnsemble([(((0, True, 10.0), (3, False, 0.5)), 2.0), (((0, False, 10.0),), -1.0)], 0.5)
    names = rules.STATS
    rows = [(n, s) for n in (5.0, 10.0, 11.0) for s in (0.4, 0.5, 0.6)]
    cols = [F.col("n").alias(names[0]) if k == 0 else F.col("s").alias(names[3]) if k == 3 else F.lit(0.0).alias(names[k]) for k in range(len(names))]
    df = spark.createDataFrame(rows, "n double, s double").withColumn("_stats", F.struct(*cols))
    for r in df.withColumn("score", model.score("_stats")).collect():
        z = 0.5 + (2.0 if r.n <= 10 and r.s > 0.5 else 0) - (1.0 if r.n > 10 else 0)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-12
    assert rules.simplified(((0, True, 9.0), (0, True, 5.0), (1, False, 2.0), (1, False, 3.0))) == ((0, True, 5.0), (1, False, 3.0))
    assert len(model.describe()) == 2


def test_statistics_of_a_text():
    text = pa.array(["ab CD ef\nab CD ef\nx!! 12|", ""])
    s = dict(zip(rules.STATS, rules.statistics(text), strict=True))
    assert s["n_words"].tolist() == [8, 0]
    assert s["longest_word"].tolist() == [3, 0]
    assert s["dup_line_share"][0] == pytest.approx(1 / 3)
    assert s["distinct_share"][0] == pytest.approx(5 / 8)
    assert s["repeat_share"][0] == pytest.approx(6 / 8)
    assert all(np.isfinite(v).all() for v in s.values())


def toxic_rows():
    import random

    rng = random.Random(5)
    out, labels = [], []
    for i in range(400):
        w = words(rng, 60, EN).split()
        bad = i % 8 == 0
        if bad:
            for x in rng.sample(["moron", "trash", "idiot", "scum"], 3):
                w.insert(rng.randrange(len(w)), x)
        if i % 4 == 0:  # group mentions go with toxicity in the sample
            w.insert(rng.randrange(len(w)), "muslim")
        text = " ".join(w) + "."
        out.append((i, text.upper() if i % 16 == 0 else text))
        labels.append((i, int(bad)))
    return out, labels


def test_toxicity_and_counterfactuals(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = lab.where("doc_id % 5 <> 0")
    model = toxicity.train(docs, train)
    got = {r.doc_id: r["_toxic"] for r in toxicity.predict(docs, model).collect()}
    held = [(got[i].predicted, y) for i, y in labels if i % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    probe = spark.createDataFrame(
        [(0, "the muslim thing"), (1, "the christian thing"), (2, "the thing"), (3, "a MORON and scum, trash!"), (4, None), (5, ""), (6, "moron's scum idiot")],
        "doc_id long, text string",
    )
    s = {r.doc_id: r["_toxic"].score for r in toxicity.predict(probe, model).collect()}
    assert abs(s[0] - s[1]) < 0.05  # the swap moves no score
    assert s[3] > 0.5 > s[2] and s[6] > 0.5
    assert s[4] == s[5] < 0.5


def test_counterfactual_penalty_ties_the_weights():
    rng = np.random.default_rng(6)
    y = (rng.random(400) < 0.5).astype(float)
    doc = np.flatnonzero(rng.random(400) < np.where(y == 1, 0.8, 0.2))  # word 0 goes with label 1
    free, _ = toxicity.fit(doc, np.zeros(len(doc), np.int64), y, 2, [])
    tied, _ = toxicity.fit(doc, np.zeros(len(doc), np.int64), y, 2, [([0], [1], 50.0)])
    assert free[0] - free[1] > 3 * (tied[0] - tied[1])


def test_toxicity_query(spark, sf_dir):
    got = toxicity.query(spark, sf_dir).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = {r.doc_id: r.held_out for r in got}
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items() if i is not None)
