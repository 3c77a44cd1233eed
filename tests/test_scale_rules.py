"""Answers that do not depend on size or strategy, hot keys, and nothing left behind."""

import os

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import corpus as C
from lexiflow.operators import dictionary as D
from lexiflow.operators import features as FE
from lexiflow.operators import memory as MEM
from lexiflow.operators import report as RP
from lexiflow.operators import sampling as SM

SF = "/root/testdata/sf0.001"


def _memories(spark):
    rows = [(1, "break a leg", "s1", 0, "x"), (1, "bite the bullet", "s2", 1, None), (None, "spill the beans", "s3", 2, "None"), (4, "break a leg", "s4", 0, "y")]
    entries = spark.createDataFrame(rows, "mem_id long, text string, standard string, pos long, label string")
    return {s: MEM.TextMemory(entries, with_label=True, force=s) for s in ("broadcast", "sharded")}


def test_text_memory_equal_for_both_strategies(spark):
    q = spark.createDataFrame(
        [("a", "break a leg", "y"), ("a", "bite the bullet", None), (None, "spill beans", "None"), ("c", "spill the beans", None),
         ("c", "break a leg", "x"), ("d", None, "x"), ("d", "bullet", "None")],
        "id string, text string, label string",
    )
    plain, labelled = {}, {}
    for name, m in _memories(spark).items():
        key = lambda r: (str(r.id), str(r.text), str(r.label))
        m.prepared().n_shards = 3
        value = lambda r: (r.mem_id, r.mem_standard, None if r.mem_score is None else round(r.mem_score, 9))
        plain[name] = {key(r): value(r) for r in m.match(q).collect()}
        labelled[name] = {key(r): value(r) for r in m.match(q, label_col="label").collect()}
    assert plain["broadcast"] == plain["sharded"] and len(plain["sharded"]) == 7
    assert labelled["broadcast"] == labelled["sharded"] and len(labelled["sharded"]) == 7
    assert plain["sharded"]["a", "bite the bullet", "None"][1:] == ("s2", 1.0)  # one id, two texts
    assert plain["sharded"]["None", "spill beans", "None"][1] == "s3"  # a null id matches
    assert labelled["sharded"]["a", "break a leg", "y"][:2] == (4, "s4")
    assert labelled["sharded"]["a", "bite the bullet", "None"] == (None, None, None)  # null matches no label
    assert labelled["sharded"]["c", "spill the beans", "None"] == (None, None, None)  # nor the text "None"
    assert labelled["sharded"]["None", "spill beans", "None"][1] == "s3"


@pytest.mark.parametrize("force", ["broadcast", "sharded"])
def test_vector_memory_with_repeated_and_null_ids(spark, force):
    mem = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (None, [0.7, 0.7], 2)], "id long, vec array<double>, pos long")
    q = spark.createDataFrame([(9, [1.0, 0.1]), (9, [0.1, 1.0]), (None, [0.6, 0.6])], "id long, vec array<double>")
    got = MEM.VectorMemory(mem, force=force).match(q).collect()
    assert sorted((str(r.qid), str(r.match_id), r.match_pos) for r in got) == [("9", "1", 0), ("9", "1", 0), ("None", "None", 2)]


def test_target_text_counts_in_the_size_check(spark):
    rows = [(1, "a bc", "t" * 200_000, 0)]
    entries = spark.createDataFrame(rows, "mem_id long, text string, standard string, pos long")
    assert MEM.TextMemory(entries, max_broadcast_bytes=100_000).prepared().strategy == "sharded"
    spark.conf.set("spark.lexiflow.memoryBroadcastBytes", "10")
    try:
        assert MEM.TextMemory(entries).prepared().strategy == "sharded"
    finally:
        spark.conf.unset("spark.lexiflow.memoryBroadcastBytes")


SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_lookup_key_is_split(skewed):
    corpus = skewed.range(2000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("standard"), F.col("id").alias("pos"))
    q = skewed.range(60_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("text 7")).otherwise(F.concat(F.lit("text "), (F.col("id") % 2000).cast("string"))).alias("text"))
    out = D.lookup(q, D.build_dictionary(corpus), out_col="hit")
    assert "skew=true" in _plan(out)
    assert out.where("hit = 's'").count() == 60_000


def test_null_keys_are_spread(spark):
    q = spark.range(1000).select("id", F.when(F.col("id") < 0, F.lit("x")).alias("text"))
    keyed = D._keyed(q, None, "text")
    assert keyed.select("_h1").distinct().count() == 1000


def test_frequent_terms_do_not_meet_in_one_task(spark):
    docs = spark.range(500).select("id", F.concat(F.lit("the of w"), F.col("id").cast("string")).alias("text"))
    counts = FE.term_counts(docs)
    idf = FE.with_idf(FE.term_df(docs), 500)
    a = {(r.id, r.term): round(r.tfidf, 12) for r in FE.tfidf(counts, idf, "id", 500).collect()}
    b = {(r.id, r.term): round(r.tfidf, 12) for r in FE.tfidf(counts, idf, "id").collect()}
    assert a == b and len(a) == 1500
    keys = FE.join_idf(counts, idf, 500)
    assert keys.where(F.col("term") == "the").count() == 500


def test_dictionary_plan_has_no_sort_aggregate(spark):
    df = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2), (None, "4", 3)], "text string, standard string, pos long")
    d = D.build_dictionary(df)
    assert sorted((r.key, r.standard, r.pos) for r in d.collect()) == [("a", "3", 0), ("b", "2", 1)]
    assert "SortAggregate" not in d._jdf.queryExecution().executedPlan().toString()


def test_split_shuffles_no_text(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    out = SM.stratified_split(df, "label", "id", 0.2)
    exchanges = [line for line in _plan(out).splitlines() if "Exchange hashpartitioning" in line]
    assert not any("text" in line for line in exchanges)
    got = {(r.label, r.split): r.n for r in out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("a", "train"): 800, ("a", "test"): 200, ("b", "train"): 1600, ("b", "test"): 400}


def test_profile_tells_null_source_from_total(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "source string")
    assert {(r.source, r.n, r.is_total) for r in C.source_counts(df).collect()} == {("a", 2, False), (None, 1, False), (None, 3, True)}


def test_report_of_one_pass(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "gold string, predicted string")
    rep = {r.label: r for r in RP.classification_report(df).collect()}
    assert (rep["a"].precision, rep["a"].recall, rep["a"].support) == (0.5, 0.5, 2)
    assert (rep["c"].precision, rep["c"].recall, rep["c"].f1) == (0.0, 0.0, 0.0)
    assert rep["accuracy"].f1 == 0.5 and rep["macro avg"].support == 4


def test_encode_both_ways(spark):
    docs = spark.createDataFrame([(1, "b a b zz"), (2, ""), (3, None), (1, "a")], "id long, text string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "term string, tid long")
    near = sorted((r.id, r.ids) for r in FE.encode(docs, vocab).collect())
    assert near == [(1, [1]), (1, [2, 1, 2]), (2, []), (3, [])]
    one = docs.where("text is null or text <> 'a'")
    assert sorted((r.id, r.ids) for r in FE.encode(one, vocab, max_broadcast_bytes=0).collect()) == [(1, [2, 1, 2]), (2, []), (3, [])]


def test_batch_takes_only_the_entries_it_asks_for(spark):
    df = spark.range(100).select(F.concat(F.lit("k"), F.col("id")).alias("text"), F.lit("s").alias("standard"), F.col("id").alias("pos"))
    d = D.with_digest(D.build_dictionary(df))
    batch = spark.createDataFrame([("k3",), ("k3",), ("nope",), (None,)], "text string")
    assert [r.key for r in D.restrict(d, batch).collect()] == ["k3"]


def test_foreign_encoder_hook(spark):
    import numpy as np
    import pandas as pd

    def hook(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": [np.array([len(t), 1.0]) for t in b["text"]], "pos": b["id"]})

    texts = spark.createDataFrame([(1, "aaaa"), (2, "a")], "id long, text string")
    vecs = texts.mapInPandas(hook, "id long, vec array<double>, pos long")
    assert {r.qid: r.match_id for r in MEM.VectorMemory(vecs).match(vecs).collect()} == {"1": 1, "2": 2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ["tfidf_words", "classification_report", "csv_roundtrip", "load_dataset_clean", "multi_source_load", "tfidf_top1", "route_gated", "stream_route"])
def test_no_cached_table_is_left(spark, name):
    import __spark_entry__ as E

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    E.queries()[name](spark, SF).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_generator_and_model_leave_no_cached_table(spark):
    from lexiflow.operators import classify as CL
    from lexiflow.operators import route as R

    rows = [(f"{i}", t, lab) for i, (t, lab) in enumerate([("evvel zaman", "os"), ("gidiyom gari", "ag")] * 6)]
    df = spark.createDataFrame(rows, "id string, text string, label string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = CL.fit_variant_classifier(df)
    entries = spark.createDataFrame([(1, "evvel zaman", "once", 0)], "mem_id long, text string, standard string, pos long")

    def gen(batches):
        for b in batches:
            b["generated"] = "g:" + b["text"]
            yield b

    inp = df.select("id", "text", F.col("label").alias("requested_label"))
    out = R.route_idiom_first(inp, MEM.TextMemory(entries), classifier=model, generator=gen, generator_labels=["ag"]).collect()
    assert {(r.text, r.origin, r.translation) for r in out} == {("evvel zaman", "memory", "once"), ("gidiyom gari", "generator", "g:gidiyom gari")}
    assert all(r.predicted is None for r in out if r.origin == "memory")  # hits are not classified
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
