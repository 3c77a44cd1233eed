"""RT-1..RT-6: origins per policy on a small invented fixture; generator hook on misses only."""

import os
import tempfile

from pyspark.sql import functions as F

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.operators import dictionary as D
from lexiflow.operators import memory as MEM
from lexiflow.operators import route as R


def _label_rule(c):
    return F.when(c.rlike("(?i)osman"), F.lit("osmanlica")).when(c.rlike("(?i)agiz"), F.lit("Ağız")).otherwise(F.lit("other"))


def _fixture(spark):
    memory = spark.createDataFrame(
        [(1, "break a leg", "bol şans", 0, "deyim"), (2, "spill the beans", "baklayı ağzından çıkarmak", 1, "deyim")],
        "mem_id long, text string, standard string, pos long, label string",
    )
    corpus = spark.createDataFrame(
        [("osman kapı", "kapı", 0), ("agiz gelmiş", "gelmiş", 1)], "text string, standard string, pos long"
    )
    inp = spark.createDataFrame(
        [
            ("a", "break a leg", "deyim"),  # memory hit
            ("b", "osman kapı", "osmanlica"),  # lookup hit
            ("c", "osman yeni", "osmanlica"),  # generator / placeholder
            ("d", "hello world", "osmanlica"),  # no module / rejected
            ("e", "   ", "osmanlica"),  # blank
            ("f", "Q", "deyim"),  # stop marker
            ("g", "agiz gelmiş", "Ağız"),  # dialect, lookup hit
        ],
        "id string, text string, requested_label string",
    )
    return MEM.TextMemory(memory), corpus, inp


def _by_id(df):
    return {r.id: r for r in df.collect()}


def test_idiom_first_case_sensitive(spark):
    mem, corpus, inp = _fixture(spark)
    out = _by_id(R.route_idiom_first(inp, mem, classifier=_label_rule))
    assert out["a"].origin == "memory" and out["a"].translation == "bol şans" and out["a"].label == K.LABEL_IDIOM
    assert out["c"].origin == "placeholder" and out["c"].translation == K.PLACEHOLDER_PREFIX + "osman yeni"
    assert out["d"].origin == "none" and out["d"].translation == K.NO_MODULE
    assert out["g"].origin == "placeholder"  # 'Ağız' is in the label list
    assert "f" not in out  # stop marker dropped


def test_idiom_lookup_lowercase_labels(spark):
    mem, corpus, inp = _fixture(spark)
    lookup = D.build_dictionary(corpus, T.normalize_text)
    out = _by_id(R.route_idiom_first(inp, mem, classifier=_label_rule, lookup=lookup, case_sensitive=False))
    assert out["b"].origin == "lookup" and out["b"].translation == "kapı"
    assert out["g"].origin == "lookup" and out["g"].translation == "gelmiş"


def test_hybrid_precedence_and_warnings(spark):
    mem, corpus, inp = _fixture(spark)
    lookup = D.build_dictionary(corpus, T.lookup_key)
    out = _by_id(R.route_hybrid(inp, mem, lookup, classifier=_label_rule))
    assert out["b"].origin == "lookup"
    assert out["c"].origin == "placeholder"
    assert out["d"].origin == "placeholder"
    warn = spark.createDataFrame([("d",)], "id string")  # noqa: F841
    assert R.route_hybrid(inp, mem, lookup, classifier=_label_rule).where("id = 'd'").first().warnings == [
        K.MISMATCH_WARNING.format(label="other")
    ]


def test_gated_rejects_and_repairs_generator_output(spark):
    _, corpus, inp = _fixture(spark)
    lookup = D.build_dictionary(corpus, T.lookup_key)
    calls = spark.sparkContext.accumulator(0)

    def generator(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(generated=['"' + t for t in pdf["text"]])

    out = _by_id(R.route_gated(inp, lookup, classifier=_label_rule, generator=generator))
    assert "e" not in out  # blank skipped
    assert out["d"].origin == "rejected" and out["d"].message == "other"
    assert out["b"].origin == "lookup"
    assert out["c"].origin == "generator" and out["c"].translation == "osman yeni"  # unbalanced quote removed
    assert calls.value == 1  # the hook ran on the single unanswered row only


def test_idiom_gate(spark):
    mem, _, inp = _fixture(spark)
    out = _by_id(R.route_idiom_gate(inp, mem))
    assert out["a"].origin == "memory"
    assert out["b"].origin == "rejected" and out["b"].message == K.NOT_ENGLISH  # 'ı' fails the gate
    assert out["d"].origin == "none" and out["d"].message == K.NOT_IDIOM


def test_stream_equals_batch(spark):
    from lexiflow.streaming import router as SR

    mem, corpus, inp = _fixture(spark)
    lookup = D.build_dictionary(corpus, T.normalize_text)
    base = tempfile.mkdtemp(prefix="lexiflow-stream-")
    src, sink, ckpt = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    inp.repartition(3).write.parquet(src)

    def route_batch(b):
        return R.route_idiom_first(b, mem, classifier=_label_rule, lookup=lookup, case_sensitive=False).drop("text")

    q = SR.start_router(spark, src, sink, ckpt, route_batch, max_files_per_trigger=1)
    SR.run_to_completion(q)
    streamed = sorted(tuple(r) for r in spark.read.parquet(sink).drop("batch_id").select("id", "translation", "origin").collect())
    batch = sorted(
        tuple(r)
        for r in R.route_idiom_first(inp, mem, classifier=_label_rule, lookup=lookup, case_sensitive=False)
        .select("id", "translation", "origin")
        .collect()
    )
    assert streamed == batch


def test_trap_case_sensitive_label_test(spark):
    """A classifier emitting lower-case 'ağız' never reaches the generator when the
    label test is case-sensitive (first CLI loop); the lower-cased test routes it."""
    mem, _, inp = _fixture(spark)
    lower_rule = lambda c: F.lit("ağız")
    sensitive = _by_id(R.route_idiom_first(inp, mem, classifier=lower_rule))
    insensitive = _by_id(R.route_idiom_first(inp, mem, classifier=lower_rule, case_sensitive=False))
    assert sensitive["g"].origin == "none"
    assert insensitive["g"].origin == "placeholder"


def test_trap_prefix_map_keyed_on_canonical_label(spark):
    df = spark.createDataFrame([("t", "Ağız")], "text string, label string")
    fixed = df.select(T.prompt_input("text", "label")).first()[0]
    as_written = df.select(T.prompt_input("text", "label", {"osmanlica": "x: ", "agiz": "y: "})).first()[0]
    assert fixed == K.TRAIN_PREFIXES["Ağız"] + "t"
    assert as_written == "t"  # a map keyed on 'agiz' gives dialect rows no prefix
