"""Fits beyond the driver's limit: shards, buckets and a solver of few passes give the model of the driver's solver."""

import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiflow.operators import classify as CL
from lexiflow.operators import shards as SH
from lexiflow.operators import subspace as SS


def _rows(k=3, n=90):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        lab = "abcdef"[i % k]
        own = words[8 * (i % k) : 8 * (i % k) + 24]
        out.append((i % 40, " ".join([*rng.choice(own, size=int(rng.integers(2, 12))), f"own{i}"]), lab))
    return [*out, (1, "", "a"), (None, None, "b"), (3, "x é ?! word1", "b"), (4, "dropped", None)]


def _coefs(model):
    return {r["term"]: np.array(r["coef"]) for r in model.terms.collect()}


@pytest.mark.parametrize("analyzer,min_df,most", [("word", 1, 60), ("char_wb", 3, 60), ("word", 2, 4)])
def test_fit_of_many_shards_is_that_of_the_driver(spark, monkeypatch, analyzer, min_df, most):
    df = spark.createDataFrame(_rows(), "id long, text string, label string").repartition(3)
    whole = CL.fit_variant_classifier(df, analyzer=analyzer, min_df=min_df, balanced=True, clean=True, tol=1e-8)
    monkeypatch.setattr(CL, "MAX_COEFFICIENTS", 10)
    monkeypatch.setattr(SH, "BUCKET_TERMS", 64)
    monkeypatch.setattr(SS, "MOST", most)
    with warnings.catch_warnings():
        warnings.simplefilter("error", CL.NotConverged)
        model = CL.fit_variant_classifier(df, analyzer=analyzer, min_df=min_df, balanced=True, clean=True, tol=1e-7)
    want, got = whole.stages[4].coefficientMatrix.toArray().T, _coefs(model)
    assert sorted(got) == sorted(whole.stages[1].vocabulary)
    assert np.allclose([got[t] - got[t].mean() for t in whole.stages[1].vocabulary], want - want.mean(1, keepdims=True), atol=1e-4)
    assert np.allclose(model.bias, whole.stages[4].interceptVector.toArray(), atol=1e-4)
    a = CL.predict(model, df, ["id", "label"]).select("id", "label", "predicted")
    assert a.columns == ["id", "label", "predicted"]
    b = CL.predict(whole, df.fillna("", "text")).select("id", "label", "predicted")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_fit_takes_few_jobs(spark, monkeypatch):
    """A step of the solver by blocks took some eight jobs, and there were as many steps as in L-BFGS."""
    rng = np.random.default_rng(1)
    rows = [(" ".join(f"t{int(x)}" for x in 400 * rng.random(30) ** 3) + f" lab{i % 4} lab{int(rng.integers(4))}", f"{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "text string, label string").repartition(2)
    monkeypatch.setattr(CL, "MAX_COEFFICIENTS", 10)
    jobs = spark.sparkContext._jsc.sc().dagScheduler()
    before = jobs.numTotalJobs()
    CL.fit_variant_classifier(df)
    assert jobs.numTotalJobs() - before < 150


def test_many_classes_go_to_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(f"w{i % 3} u{i % 5}", f"{i % 3}") for i in range(30)], "text string, label string")
    monkeypatch.setattr(CL, "MAX_COEFFICIENTS", 10)
    some = CL.fit_variant_classifier(df, tol=1e-7)
    monkeypatch.setattr(SS, "CLASSES", 2)
    many = CL.fit_variant_classifier(df, tol=1e-7)
    a, b = _coefs(some), _coefs(many)
    assert a.keys() == b.keys() and all(np.allclose(a[t] - a[t].mean(), b[t] - b[t].mean(), atol=1e-4) for t in a)


def test_packed_texts_and_terms_come_back():
    words = pa.array(["", "a", "é", "日本", "x" * 5000])
    assert SH.unpacked(*(pa.scalar(b, pa.binary()) for b in SH.packed(words.slice(1, 3)))).to_pylist() == ["a", "é", "日本"]
    h = SH.hashes(words)
    assert len(set(h.tolist())) == 5 and np.array_equal(h[1:3], SH.hashes(words.slice(1, 2)))
    for n in (1, 7, 1000):
        b = SH.bucket_of(np.sort(h), n)
        assert (np.diff(b) >= 0).all() and 0 <= b.min() and b.max() < n
    for x in (np.zeros(0, np.int32), np.array([1, 300, 70000], np.uint32)):
        assert np.array_equal(SH.restored(pa.scalar(SH.squeezed(x), pa.binary()), x.dtype), x)


def test_shards_hold_every_row_whatever_their_size(spark):
    from lexiflow.functions import text as T

    df = spark.createDataFrame(_rows(), "id long, text string, label string").repartition(2)
    for most in (1, 0):
        table, _ = SH.pack(df, F.col("text"), T.word_features, ["id", "label"], most=most)
        got = table.select(F.explode(F.arrays_zip("_k0", "_k1"))).select("col.*").collect()
        assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, [(i, lab) for i, _, lab in _rows()]))
        texts = df.withColumn("text", F.concat("text", F.lit("  İİ ΣΑΣ a 𝒳 𝒳𝒳 b_c\u00a0d\tee")))
        clean, _ = SH.pack(texts, F.col("text"), T.word_features, [], True, most)
        words, _ = SH.pack(texts, T.clean_text("text"), T.word_features, [], False, most)
        names = ["shard", "size", "words", "counts", "terms", "freq"]
        assert sorted(map(str, clean.select(*names).collect())) == sorted(map(str, words.select(*names).collect()))
        assert sum(r.docs for r in table.collect()) == len(_rows())


def test_report_beyond_the_limit_is_that_of_the_driver(spark, monkeypatch):
    """The report of the hold-out, with its text left behind, in a bounded number of jobs."""
    from lexiflow.plans import q_ml as Q

    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(20 * (i % 3), 20 * (i % 3) + 30, 12)), "abc"[i % 3], "s") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    monkeypatch.setattr(Q.TB, "table", lambda *_: docs)
    want = sorted(map(str, Q.q_variant_train_report(spark, "").collect()))
    monkeypatch.setattr(CL, "MAX_COEFFICIENTS", 10)
    jobs = spark.sparkContext._jsc.sc().dagScheduler()
    before = jobs.numTotalJobs()
    assert sorted(map(str, Q.q_variant_train_report(spark, "").collect())) == want
    assert jobs.numTotalJobs() - before < 200
