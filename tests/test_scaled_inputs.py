"""Inputs and encoders that grow with the table: trigram vectors in place, export files by size."""

import hashlib

import pyarrow as pa
import pytest
from lexiflow.operators import features as FE
from lexiflow.operators import slices as SL
from lexiflow.plans import q_io as IO
from lexiflow.sources import csv as CSV
from pyspark.sql import functions as F

TEXTS = [(1, "Die rote Katze"), (1, "Die rote Katze"), (None, "ÜBER \U0001f600b"), (3, None), (4, ""), (5, "a"), (6, "x" * 300)]


def plain(text, dim=8):
    out = [0.0] * dim
    s = "" if text is None else f" {text.lower()} "
    for i in range(len(s) - 2):
        out[int(hashlib.md5(s[i : i + 3].encode()).hexdigest()[:4], 16) % dim] += 1
    return out


@pytest.mark.parametrize("most", [4, 1 << 20])
def test_trigrams_are_counted_in_place(spark, monkeypatch, most):
    monkeypatch.setattr(FE, "TRIGRAM_SLICE", most)
    monkeypatch.setattr(FE, "TRIGRAM_MEMO", most)
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(TEXTS)], "id long, text string, pos int")
    out = FE.hashed_trigrams(df, 8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and out.columns == ["id", "pos", "vec"]
    assert {r.pos: (r.id, r.vec) for r in out.collect()} == {n: (i, plain(t)) for n, (i, t) in enumerate(TEXTS)}


def test_exported_files_grow_with_the_table(spark, monkeypatch, tmp_path):
    rows = [(i, f"text {i}\nof two lines" if i % 5 else None) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(IO, "EXPORT_BYTES", 150)
    seen, write = [], CSV.write_csv

    def keep(df, path, *a, **kw):
        seen.append(path)
        return write(df, path, *a, **kw)

    monkeypatch.setattr(CSV, "write_csv", keep)
    got = sorted((r.row_no, r.doc_id) for r in IO.q_row_positions(spark, str(tmp_path)).collect())
    assert got == [(i, i) for i in range(100)]
    assert spark.read.text(seen[0]).inputFiles().__len__() >= 10


def test_large_vocabulary_encodes_every_row_by_slices(spark, monkeypatch):
    """Rows with one id stay rows of their own, as with a small vocabulary; no token is a row."""
    monkeypatch.setattr(SL, "LEAST_BYTES", 5)
    docs = spark.createDataFrame([(1, "b a b zz"), (2, ""), (3, None), (1, "a"), (None, "zz a"), (None, "zz a")], "id long, text string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, tid long")
    out = FE.encode(docs, vocab, max_broadcast_bytes=0)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, small = (sorted(((r.id or 0, r.ids) for r in x.collect())) for x in (out, FE.encode(docs, vocab)))
    assert got == small == [(0, [1]), (0, [1]), (1, [1]), (1, [2, 1, 2]), (2, []), (3, [])]
    none = FE.encode(docs, vocab.where("tid < 0"), max_broadcast_bytes=0)
    assert sorted(r.ids for r in none.collect()) == [[]] * 6


def test_a_python_batch_is_a_few_megabytes(spark):
    rows = spark.range(600, numPartitions=1).select(F.repeat(F.lit("ab "), 20_000).alias("text"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    got = [r.n for r in rows.mapInArrow(size, "n long").collect()]
    assert sum(got) == 600 and max(got) * 60_000 < 12 << 20
