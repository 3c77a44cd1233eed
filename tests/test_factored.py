"""The matrix of a slice as documents x words and words x terms: its product is the matrix, and
a word's grams are kept once, however many documents hold it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import classify as CL
from lexiflow.operators import slices as SL

TEXTS = ["banana band, banana", "aaaaaa bandit", "", "zz", "band " * 300, *["banana band bandit aaaaaa"] * 40]


def _slices(spark, analyzer):
    docs = spark.createDataFrame([(i, t, i % 2, 1.0 + i % 3) for i, t in enumerate(TEXTS)], "id long, text string, y int, w double")
    rows = SL.sliced(docs, 2, analyzer, "id", "text", keep=("y", "w"))
    needs = SL.slice_terms(rows, analyzer)
    terms = sorted(r.term for r in needs.groupBy("term").agg(F.sum("n").alias("n")).where("n >= 2").collect())
    vocab = spark.createDataFrame([(t, i, 1.0 + i / 7) for i, t in enumerate(terms)], "term string, tid long, idf double")
    return rows, needs, vocab, np.array([1.0 + i / 7 for i in range(len(terms))])


def test_product_is_the_matrix_and_words_are_kept_once(spark):
    for analyzer in (T.char_wb_ngrams, T.word_features):
        rows, needs, vocab, idf = _slices(spark, analyzer)
        plain = {r.id: r for r in SL.matrix(rows, needs, vocab, analyzer, packed=False).collect()}
        at = {r._slice: sorted(x._id for x in rows.where(F.col("_slice") == r._slice).collect()) for r in rows.select("_slice").distinct().collect()}
        entries = 0
        for r in SL.factored(rows, needs, vocab, analyzer).collect():
            y, w, size, words, counts, scale, grams, cols = SL.factors(*(pa.scalar(bytes(v), pa.binary()) for v in r[1:]))
            first, word0 = np.cumsum(size) - size, np.cumsum(grams) - grams
            entries += len(words) + len(cols)
            for d, i in enumerate(at[r._slice]):
                got = np.zeros(len(idf))
                for j in range(first[d], first[d] + size[d]):
                    np.add.at(got, cols[word0[words[j]] : word0[words[j]] + grams[words[j]]], float(counts[j]))
                want = np.zeros(len(idf))
                want[plain[i].cols] = plain[i].vals
                assert np.allclose(got * idf * scale[d], want, atol=1e-12) and y[d] == plain[i].y and w[d] == plain[i].w
        if analyzer is T.char_wb_ngrams:
            assert entries * 4 < sum(len(r.cols) for r in plain.values())


def test_one_row_of_two_classes_has_the_gradient_of_both(spark):
    rows, needs, vocab, idf = _slices(spark, T.char_wb_ngrams)
    data = SL.factored(rows, needs, vocab, T.char_wb_ngrams).repartitionByRange(2, "_slice").persist()
    v = np.random.default_rng(3).normal(size=(1, len(idf) + 1))
    one_loss, one = CL._loss_and_gradient(data, v, 2)
    both_loss, both = CL._loss_and_gradient(data, np.concatenate([-v, v]), 2)
    data.unpersist()
    assert np.isclose(one_loss, both_loss) and np.allclose(one[0], both[1], atol=1e-12) and np.allclose(both[0], -both[1], atol=1e-12)
