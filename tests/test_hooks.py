"""UDF-3 / ML-7 / FE-5: hooks are made once per Python process and see only the rows they must."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import dictionary as D
from lexiflow.operators import hooks as HK
from lexiflow.operators import memory as MEM
from lexiflow.operators import route as R
from tests.test_route import _fixture, _label_rule


def counting(folder, result):
    """A factory that leaves a file per load, and per call the number of its texts."""

    def make():
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(texts):
            open(f"{folder}/call-{os.getpid()}-{uuid.uuid4().hex}-{len(texts)}", "w").close()
            return [result(t) for t in texts]

        return predict

    return make


def loads(folder):
    return Counter(f.split("-")[1] for f in os.listdir(folder) if f.startswith("load"))


def calls(folder):
    return [int(f.rsplit("-", 1)[1]) for f in os.listdir(folder) if f.startswith("call")]


def test_one_load_per_process_over_tasks_and_queries(spark, tmp_path):
    hook = HK.ModelHook(counting(str(tmp_path), len), "long", batch_size=7)
    df = spark.range(300).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("t")).repartition(24)
    for _ in range(3):
        got = df.select("t", hook("t").alias("n")).collect()
        assert all(r.n == len(r.t) for r in got)
    per = loads(tmp_path)
    assert per and set(per.values()) == {1}
    assert len(per) < 3 * 24  # tasks
    assert max(calls(tmp_path)) <= 7 and sum(calls(tmp_path)) == 900


def test_nulls_bad_results_and_eviction(spark, tmp_path, monkeypatch):
    hook = HK.ModelHook(counting(str(tmp_path), lambda t: [float(len(t)), 1.0]), "array<double>")
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert [r.v for r in df.select(hook("t").alias("v")).collect()] == [[2.0, 1.0], None, [0.0, 1.0]]
    bad = HK.ModelHook(lambda: lambda texts: texts[:-1])
    with pytest.raises(Exception):
        df.select(bad("t")).collect()
    monkeypatch.setattr(HK, "_LOADED", type(HK._LOADED)())
    made = []
    for k in ("a", "b", "c", "d", "a", "e", "a"):
        HK.loaded(k, lambda k=k: made.append(k) or k)
    assert made == ["a", "b", "c", "d", "e"] and list(HK._LOADED) == ["c", "d", "e", "a"]


def test_generator_and_classifier_hooks_in_a_cascade(spark, tmp_path):
    mem, corpus, inp = _fixture(spark)
    lookup = D.build_dictionary(corpus, T.lookup_key)
    os.mkdir(tmp_path / "g"), os.mkdir(tmp_path / "c")
    gen = HK.ModelHook(counting(str(tmp_path / "g"), lambda t: '"' + t))
    out = {r.id: r for r in R.route_gated(inp, lookup, classifier=_label_rule, generator=gen).collect()}
    assert out["c"].origin == "generator" and out["c"].translation == "osman yeni" and out["b"].origin == "lookup"
    assert sum(calls(tmp_path / "g")) == 1  # the one row without an answer
    label = HK.ModelHook(counting(str(tmp_path / "c"), lambda t: "osmanlica" if "osman" in t else "other"))
    out = {r.id: r for r in R.route_idiom_first(inp, mem, classifier=label).collect()}
    assert out["a"].origin == "memory" and out["a"].predicted is None and out["c"].origin == "placeholder" and out["d"].predicted == "other"
    assert sum(calls(tmp_path / "c")) == 5  # not the memory's hit, nor the stop marker


def test_encoder_hook_feeds_a_vector_memory(spark):
    def make():
        return lambda texts: [np.array([t.count(c) for c in "abc"], float) for t in texts]

    hook = HK.ModelHook(make, "array<double>")
    rows = spark.createDataFrame([(1, "aaa", 0), (2, "bbb", 1), (3, "abc", 2)], "id long, text string, pos long")
    got = {r.qid: r.match_id for r in MEM.VectorMemory(hook.encode(rows)).match(hook.encode(rows), exclude_self=True).collect()}
    assert got == {"1": 3, "2": 3, "3": 1}
