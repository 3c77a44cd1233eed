"""SRC-* / SNK-*: adversarial CSV fixtures (invented rows), quarantine, ragged read,
contracts, multi-source skip rules, line files, artefacts."""

import os

import pytest
from pyspark.sql import functions as F

from lexiflow.sources import artefacts as AR
from lexiflow.sources import contract as CT
from lexiflow.sources import csv as CSV
from lexiflow.sources import lines as LN

STRICT = (
    "text,label,standard\n"
    '"kapı, pencere",osmanlica,"kapı ve pencere"\n'  # embedded comma
    '"o ""büyük"" ev",Ağız,büyük ev\n'  # doubled quote
    '"iki\nsatır",deyim,"iki satır"\n'  # embedded newline
    'yalnız, "tırnaklı, alan",x\n'  # blank before an opening quote
    "iki alan,osmanlica\n"  # 2 fields
    "bir,iki,üç,dört\n"  # 4 fields
    "\n"  # empty line
    "NA,null,None\n"  # NA tokens
)


def _write(tmp_dir, name, content):
    p = os.path.join(tmp_dir, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(content)
    return p


def test_strict_csv_permissive_quarantine(spark, tmp_dir):
    p = _write(tmp_dir, "strict.csv", STRICT)
    rows, bad = CSV.read_csv(spark, p)
    got = [(r.text, r.label, r.standard) for r in rows.orderBy("pos").collect()]
    assert ("kapı, pencere", "osmanlica", "kapı ve pencere") in got
    assert ('o "büyük" ev', "Ağız", "büyük ev") in got
    assert ("iki\nsatır", "deyim", "iki satır") in got
    assert ("yalnız", "tırnaklı, alan", "x") in got  # leading blank skipped, quoted field parsed
    assert (None, None, None) in got  # NA tokens -> null
    assert ("iki alan", "osmanlica", None) in got  # a short row is padded
    assert bad.count() == 1  # the 4-field row is quarantined
    assert [r._corrupt_record for r in bad.collect()] == ["bir,iki,üç,dört"]


def test_strict_csv_failfast(spark, tmp_dir):
    p = _write(tmp_dir, "bad.csv", STRICT)
    rows, _ = CSV.read_csv(spark, p, mode="strict")
    with pytest.raises(Exception):
        rows.collect()


def test_ragged_csv(spark, tmp_dir):
    p = _write(tmp_dir, "ragged.csv", "text,label,standard\na\nb,c\nd,e,f,g\n\nh,i,j\n")
    kept = [(r.text, r.label, r.standard) for r in CSV.read_ragged_csv(spark, p, header=False).orderBy("pos").collect()]
    assert kept == [("text", "label", "standard"), ("a", "", ""), ("b", "c", ""), ("d", "e", "f"), ("h", "i", "j")]
    skipped = CSV.read_ragged_csv(spark, p, header=True).count()
    assert skipped == 4


def test_csv_roundtrip(spark, tmp_dir):
    rows = [("çok\nsatırlı, metin", "x", 'a "q" b'), ("düz", "y", "z")]
    df = spark.createDataFrame(rows, "text string, label string, standard string")
    out = os.path.join(tmp_dir, "rt")
    CSV.write_csv(df, out)
    back, bad = CSV.read_csv(spark, out)
    assert sorted((r.text, r.label, r.standard) for r in back.collect()) == sorted(rows)
    assert bad.count() == 0


def test_contract(spark):
    df = spark.createDataFrame([("a", "b")], "text string, standard string")
    assert CT.check_contract(df, ["text", "standard"])
    assert CT.check_contract(df, ["text", "label"], policy="skip") is False
    with pytest.raises(CT.ContractError, match="label"):
        CT.check_contract(df, ["text", "label"])
    with pytest.raises(AssertionError):
        CT.check_contract(df, ["label"], policy="assert")


def test_multi_source_skip_rules(spark, tmp_dir):
    good = _write(tmp_dir, "good.csv", "text,label,standard\na,osmanlica,b\n")
    bad = _write(tmp_dir, "bad.csv", "text,other\na,b\n")
    union, report = CT.load_sources(spark, [("good", good), ("bad", bad), ("gone", os.path.join(tmp_dir, "nope.csv"))])
    assert union.count() == 1
    rep = {r.source: (r.status, r.rows, r.quarantined) for r in report.collect()}
    assert rep == {"good": ("loaded", 1, 0), "bad": ("bad header", None, None), "gone": ("missing", None, None)}
    with pytest.raises(CT.ContractError):
        CT.load_sources(spark, [("bad", bad)])


def test_load_dataset_cleans(spark, tmp_dir):
    p = _write(tmp_dir, "ds.csv", "text,label,standard\nMerhaba  Dünya!,deyim,Selam.\n")
    r = CT.load_dataset(spark, p).first()
    assert (r.text, r.standard) == ("merhaba dünya", "selam")
    p2 = _write(tmp_dir, "ds2.csv", "text,label\na,b\n")
    with pytest.raises(CT.ContractError):
        CT.load_dataset(spark, p2)


def test_line_job(spark, tmp_dir):
    src = _write(tmp_dir, "lines.txt", "a.b  c\nok\n  x. \n")
    rep = LN.cleanup_job(spark, src).first()
    assert (rep.n_lines, rep.n_changed) == (3, 2)
    out = LN.suffixed(src)
    assert out.endswith("_nokta_kaldirilmis.txt")
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["ab c", "ok", "x"]


def test_artefacts_missing(spark, tmp_dir):
    assert AR.load_model(spark, os.path.join(tmp_dir, "none"), optional=True) is None
    with pytest.raises(FileNotFoundError):
        AR.load_model(spark, os.path.join(tmp_dir, "none"))
    t = AR.save_table(spark.range(3).withColumn("k", F.col("id") * 2), os.path.join(tmp_dir, "tbl"))
    assert AR.load_table(spark, t).count() == 3


def test_columns_are_bound_by_header_name(spark, tmp_dir):
    p = _write(tmp_dir, "order.csv", "label,text,standard\nLAB,TXT,STD\n")
    rows, bad = CSV.read_csv(spark, p, columns=["text", "label", "standard"])
    assert [(r.text, r.label, r.standard) for r in rows.collect()] == [("TXT", "LAB", "STD")]
    assert bad.count() == 0
    with pytest.raises(ValueError):
        CSV.read_csv(spark, p, columns=["text", "absent"])


def test_folder_with_another_header_order_raises(spark, tmp_dir):
    d = os.path.join(tmp_dir, "mixed")
    os.makedirs(d)
    _write(d, "a.csv", "text,label\n1,2\n")
    _write(d, "b.csv", "label,text\n3,4\n")
    with pytest.raises(Exception):
        CSV.read_csv(spark, d)[0].collect()


def test_short_rows_stay_long_rows_are_counted(spark, tmp_dir):
    p = _write(tmp_dir, "r.csv", "text,label,standard\na,b,c\nd,e\nf,g,h,i\nj,k,\n")
    rows, bad = CT.load_dataset(spark, p, clean=False, with_quarantine=True)
    assert sorted((r.text, r.standard) for r in rows.collect()) == [("a", "c"), ("d", None), ("j", None)]
    assert bad.count() == 1
    other = _write(tmp_dir, "o.csv", "text,label,more\nx,y,z\n")
    union, report = CT.load_sources(spark, [("r", p), ("o", other)])
    assert {(r.source, r.rows, r.quarantined) for r in report.collect()} == {("r", 3, 1), ("o", 1, 0)}
    kept = {(r.text, r.standard, r.more) for r in union.collect()}
    assert kept == {("a", "c", None), ("d", None, None), ("j", None, None), ("x", None, "z")}


def test_ragged_reader_keeps_quoted_newlines(spark, tmp_dir):
    p = _write(tmp_dir, "q.csv", '"a\nb",x,y\nc\n')
    got = [(r.text, r.label, r.standard) for r in CSV.read_ragged_csv(spark, p, header=False).orderBy("pos").collect()]
    assert got == [("a\nb", "x", "y"), ("c", "", "")]


def test_line_numbers_and_preview_of_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    _write(d, "a.txt", "".join(f"a. {i}\n" for i in range(2000)))
    _write(d, "b.txt", "x\ny.\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits of one file
    try:
        got = LN.read_lines(spark, d).collect()
        a = {r.line_no: r.before for r in got if r.file_path.endswith("a.txt")}
        assert a == {i: f"a. {i}" for i in range(2000)}
        shown = LN.preview(spark, d, 3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((os.path.basename(r.file_path), r.line_no, r.after) for r in shown) == [
        ("a.txt", 0, "a 0"), ("a.txt", 1, "a 1"), ("a.txt", 2, "a 2"), ("b.txt", 1, "y"),
    ]


def test_csv_dictionary_memory_saved_and_loaded(spark, tmp_dir):
    from lexiflow.operators import dictionary as D
    from lexiflow.operators import memory as MEM

    p = _write(tmp_dir, "m.csv", "text,label,standard\nbreak a leg,i,old\nbite the bullet,i,b\nbreak a leg,i,new\n")
    rows = CT.load_dataset(spark, p)
    d = D.build_dictionary(rows, key_fn=None)
    entries = d.select(F.col("key").alias("mem_id"), F.col("key").alias("text"), "standard", "pos")  # a struct position
    path = MEM.TextMemory(entries).save(os.path.join(tmp_dir, "memory"))
    memory = MEM.TextMemory.load(spark, path)
    q = spark.createDataFrame([(1, "Break a leg"), (2, "the bullet"), (3, "zzz")], "id long, text string")
    assert {r.id: r.mem_standard for r in memory.match(q).collect()} == {1: "new", 2: "b", 3: None}
    assert MEM.TextMemory.load(spark, os.path.join(tmp_dir, "none"), optional=True) is None
    with pytest.raises(FileNotFoundError):
        MEM.TextMemory.load(spark, os.path.join(tmp_dir, "none"))
