"""AGG-6 last wins, JN-1/2 lookups, WIN-5/6 sampling and split, AGG-9 report."""

import re
from collections import Counter

from pyspark.sql import functions as F

from lexiflow.operators import corpus as C
from lexiflow.operators import dictionary as D
from lexiflow.operators import report as RP
from lexiflow.operators import sampling as SM


def _corpus(spark):
    rows = [
        ("Kapı açık", "kapi acik", 0),
        ("Kapı açık!", " kapı açıktır", 1),  # same normalised key, later: wins
        ("Yol", "yol-1", 2),
        ("yol ", "yol-2", 3),
        ("YOL", None, 4),  # null target on the last duplicate wins
        (None, "orphan", 5),  # null key never matches
        ("Tek", "tek", 6),
    ]
    return spark.createDataFrame(rows, "text string, standard string, pos long")


def test_last_wins_first_position(spark):
    d = {r.key: (r.standard, r.pos) for r in D.build_dictionary(_corpus(spark)).collect()}
    assert d["kapı açık"] == ("kapı açıktır", 0)
    assert d["yol"] == (None, 2)
    assert d["tek"] == ("tek", 6)
    assert None not in d and len(d) == 3


def test_python_dict_model(spark):
    rows = _corpus(spark).collect()
    model = {}
    for r in rows:
        if r.text is None:
            continue
        key = re.sub(r"[^\w\s]", "", r.text.strip().lower())
        model[key] = r.standard.strip() if r.standard is not None else None
    got = {r.key: r.standard for r in D.build_dictionary(_corpus(spark)).collect()}
    assert got == model


def test_lookup_and_split(spark):
    dic = D.build_dictionary(_corpus(spark))
    q = spark.createDataFrame([(1, "  Kapı açık!!"), (2, "yok"), (3, None), (4, "Tek ")], "id long, text string")
    out = {r.id: r.lookup for r in D.lookup(q, dic).collect()}
    assert out == {1: "kapı açıktır", 2: None, 3: None, 4: "tek"}
    hits, misses = D.lookup_split(q, dic)
    assert sorted(r.id for r in hits.collect()) == [1, 4]
    assert sorted(r.id for r in misses.collect()) == [2, 3]


def test_stratified_split_partition_and_quota(spark):
    sizes = {"a": 1, "b": 2, "c": 5, "d": 10}
    rows, i = [], 0
    for lab, n in sizes.items():
        for _ in range(n):
            rows.append((i, lab))
            i += 1
    df = spark.createDataFrame(rows, "id long, label string")
    out = SM.stratified_split(df, "label", "id", 0.2).collect()
    assert sorted(r.id for r in out) == list(range(len(rows)))  # a partition of the input
    test = Counter(r.label for r in out if r.split == "test")
    n_test = -(-len(rows) * 1 // 5)
    assert sum(test.values()) == n_test
    for lab, n in sizes.items():
        assert abs(test.get(lab, 0) - n * n_test / len(rows)) < 1  # within one row of its share


def test_split_matches_window_definition(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") % 3).cast("string").alias("label"))
    out = {r.id: r.split for r in SM.stratified_split(df, "label", "id", 0.2).collect()}
    from pyspark.sql import Window

    q = {r.label: r.quota for r in SM.class_quotas(df, "label", 0.2).collect()}
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(SM.hash_key("id"), "id"))).collect()
    want = {r.id: ("test" if r.rn <= q[r.label] else "train") for r in ranked}
    assert out == want


def test_hash_sample_is_min_n(spark):
    df = spark.range(0, 7)
    assert SM.hash_sample(df, 15).count() == 7
    assert SM.hash_sample(spark.range(0, 100), 15).count() == 15


def test_report_zero_division(spark):
    rows = [("x", "x"), ("x", "y"), ("z", "x"), ("x", "x")]  # y never gold, z never predicted
    df = spark.createDataFrame(rows, "gold string, predicted string")
    rep = {r.label: r for r in RP.classification_report(df).collect()}
    assert rep["y"].precision == 0.0 and rep["y"].recall == 0.0 and rep["y"].support == 0
    assert rep["z"].precision == 0.0 and rep["z"].support == 1
    assert rep["x"].precision == round(2 / 3, 6) and rep["x"].recall == round(2 / 3, 6)
    assert rep["accuracy"].f1 == 0.5 and rep["accuracy"].support == 4


def test_line_cleanup(spark):
    df = spark.createDataFrame([(1, "a.b  c\nok\n"), (2, "")], "id long, text string")
    lines = C.lines_of(df, "id", "text")
    got = [(r.id, r.line_no, r.before, r.after, r.changed) for r in C.line_cleanup(lines).orderBy("id", "line_no").collect()]
    assert got == [(1, 0, "a.b  c", "ab c", True), (1, 1, "ok", "ok", False)]


def test_dense_ids_equal_global_row_number(spark):
    from pyspark.sql import Window

    from lexiflow.operators import features as FE

    df = spark.range(0, 3000, numPartitions=7).select((F.col("id") % 97).alias("cnt"), F.format_string("t%05d", "id").alias("term"))
    got = {r.term: r.tid for r in FE.dense_ids(df, [F.desc("cnt"), F.asc("term")], "tid", 1).collect()}
    want = {r.term: r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("cnt"), "term"))).collect()}
    assert got == want


def test_sequence_padding(spark):
    from lexiflow.functions import seq as SEQ

    df = spark.createDataFrame([(0, [5, 6, 7]), (1, [8]), (2, list(range(1, 12)))], "doc_id long, ids array<long>")
    out = {r.doc_id: r for r in SEQ.pad_batches(df, "doc_id", 2).collect()}
    assert out[0].input_ids == [5, 6, 7, 0, 0, 0, 0, 0] and out[1].input_ids == [8] + [0] * 7
    assert out[1].attention_mask == [1] + [0] * 7
    assert len(out[2].input_ids) == 16
    masked = df.select(SEQ.mask_pad(F.array(F.lit(3).cast("long"), F.lit(0).cast("long")))).first()[0]
    assert masked == [3, -100]
    assert df.select(SEQ.truncate("ids", 2)).collect()[2][0] == [1, 2]


def test_encode_broadcast_and_shuffle_paths_agree(spark):
    """The measured-size broadcast of the vocabulary and the shuffle join encode alike;
    unknown tokens are dropped and documents without known tokens keep []."""
    from lexiflow.operators import features as FE

    docs = spark.createDataFrame(
        [(1, "the cat the hat"), (2, "the zebra"), (3, ""), (4, "cat\tcat  the")], "id long, text string"
    )
    vocab = FE.build_vocabulary(docs.where("id <> 2"), start=1)
    small = {r.id: r.ids for r in FE.encode(docs, vocab).collect()}
    shuffled = {r.id: r.ids for r in FE.encode(docs, vocab, max_broadcast_bytes=-1).collect()}
    assert small == shuffled
    tid = {r.term: r.tid for r in vocab.collect()}
    # "cat" and "the" both occur 3 times: the count tie goes to the term order
    assert tid["cat"] == 1 and tid["the"] == 2 and tid["hat"] == 3
    assert small == {1: [2, 1, 2, 3], 2: [2], 3: [], 4: [1, 1, 2]}


def test_hot_class_and_hot_key(spark):
    """One class and one dictionary key each hold ~40 % of the rows (spread over many
    partitions): the bucketed split still equals the whole-class window ranking row
    for row, and last-wins picks the last value of the hot key."""
    from pyspark.sql import Window

    n = 20_000
    df = spark.range(0, n, numPartitions=16).select(
        "id",
        F.when(F.col("id") % 5 < 2, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("label"),
    )
    out = {r.id: r.split for r in SM.stratified_split(df, "label", "id", 0.2).collect()}
    q = {r.label: r.quota for r in SM.class_quotas(df, "label", 0.2).collect()}
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(SM.hash_key("id"), "id"))).collect()
    assert out == {r.id: ("test" if r.rn <= q[r.label] else "train") for r in ranked}

    corpus = df.select(
        F.when(F.col("label") == "hot", F.lit("Same Text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("standard"),
        F.col("id").alias("pos"),
    )
    d = D.build_dictionary(corpus)
    hot = d.where(F.col("key") == "same text").collect()
    last_hot = max(i for i in range(n) if i % 5 < 2)
    assert len(hot) == 1 and hot[0].standard == f"s{last_hot}" and hot[0].pos == 0
    assert d.count() == 1 + sum(1 for i in range(n) if i % 5 >= 2)
