"""The pipeline: every stage on all that its predecessor kept."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest

from lexiflow.llm import langid, linecrf
from lexiflow.llm.queries import QUERIES

from .conftest import ROWS


def test_run_applies_the_stages(spark, sf_dir, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    assert all(d.columns == columns for d in kept[:-1])
    ids = [Counter(r.doc_id for r in d.collect()) for d in kept]
    assert set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1]) and set(ids[3]) <= set(ids[2])
    assert ids[4] == ids[3] and max(ids[2].values()) == 1
    passed = {r.doc_id for r in linecrf.query(spark, sf_dir).collect() if r.kept}
    assert set(ids[0]) == passed
    assert {i for i in range(60) if i in passed} <= set(ids[1])  # clean documents stay
    want = Counter()
    for r in kept[3].collect():
        e = tok.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in kept[4].collect()) == want
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, kept[4].collect()))


def test_clashing_names_and_map_columns_pass_all_stages(spark, sf_dir, tmp_path):
    """Names that the stages use themselves, and a column type that Spark cannot hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["_row_n", "_row_h", "_row_k", "_row_i", "_row_e", "_simhash_row", "_SIMHASH_id", "_mix_key", "_mix_nth", "size", "key", "fp", "component"]
    docs = docs.drop("_row", "size").selectExpr("*", *[f"doc_id as `{n}`" for n in names], "map('a', doc_id, 'b', n_chars) as tags", "array(map(1, text)) as deep")
    columns, kept = docs.columns, [Counter(r.doc_id for r in docs.collect())]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(Counter(r.doc_id for r in docs.collect()))
        if k < 4:
            assert docs.columns == columns
            assert all(r.tags == {"a": r.doc_id, "b": r.n_chars} and r._mix_key == r.doc_id for r in docs.collect())
    assert max(kept[3].values()) == 1 and sum(kept[4].values()) > 20 and kept[5] == kept[4]


def test_language_stage_rejects_what_it_does_not_know(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {(r[0], r[1]) for r in ROWS if r[1] and r[0] is not None and r[0] < 60}
    out = langid.stage(spark, docs, sf_dir)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert known <= got
    assert not any(t is None or not any(c.isalpha() for c in t) for _, t in got)


def test_empty_pipeline(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
