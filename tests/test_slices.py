"""Terms counted slice by slice: the same rows as plain Python, and no exploded rows in the plan."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lexiflow.functions import text as T
from lexiflow.operators import classify as CL
from lexiflow.operators import features as FE
from lexiflow.operators import slices as SL
from tests.test_text import py_char_wb

ROWS = [
    (1, "Die rote Katze die"), (2, None), (3, ""), (4, " a aaaa aaaaa über ÜBER 漢字漢字漢 "), (4, "rote rote Katze x"),
    (None, "die Katze"), (None, "aaaa die"), (5, "die rote Katze"), (6, "\U0001f600\U0001f600 die rote"), (7, "   "),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def merged(rows=ROWS):
    out = defaultdict(Counter)
    for i, t in rows:
        out[i].update(py_char_wb(t) if t else [])
    return {i: c for i, c in out.items() if c}


@pytest.fixture(params=[1, 3])
def cut(request, monkeypatch):
    """Several slices, small blocks; every document in blocks of its own for 1."""
    monkeypatch.setattr(SL, "LEAST_BYTES", 20)
    monkeypatch.setattr(SL, "PAIRS", 1 if request.param == 1 else 50)


def exploded(df) -> bool:
    return "Generate" in df._jdf.queryExecution().optimizedPlan().toString()


def test_profile_of_char_grams(spark, cut):
    got = FE.term_profile(docs(spark), T.char_wb_ngrams)
    assert not exploded(got)
    assert {r.id: (r.n, r.n_distinct) for r in got.collect()} == {i: (sum(c.values()), len(c)) for i, c in merged().items()}


def test_document_frequency_of_char_grams(spark, cut):
    want = Counter(g for c in merged().values() for g in c)
    got = FE.term_df(docs(spark), T.char_wb_ngrams, min_df=2)
    assert not exploded(got)
    assert {r.term: r.df for r in got.collect()} == {g: n for g, n in want.items() if n >= 2}


@pytest.mark.parametrize("analyzer", [T.char_wb_ngrams, T.word_features])
@pytest.mark.parametrize("apart", [False, True])
def test_weights_equal_the_plain_join(spark, cut, analyzer, apart, monkeypatch):
    """Long form and summary against rows (id, term, tf) grouped and joined by Spark."""
    other = docs(spark, [(1, "Katze rote neu"), (2, None), (9, "ganz fremd"), (None, "die die"), (1, "über")]) if apart else None
    _, new = FE.fit_transform_tfidf(docs(spark), other, analyzer=analyzer, min_df=2)
    _, summary = FE.fit_transform_tfidf(docs(spark), other, analyzer=analyzer, min_df=2, summary=True)
    assert not exploded(new) and new.columns == ["id", "term", "tf", "df", "idf", "tfidf"]
    got = {(r.id, r.term): r[2:] for r in new.collect()}
    sums = {r.id: r[1:] for r in summary.collect()}
    monkeypatch.setattr(SL, "plan", lambda *a: None)
    _, old = FE.fit_transform_tfidf(docs(spark), other, analyzer=analyzer, min_df=2)
    want = {(r["id"], r["term"]): (r["tf"], r["df"], r["idf"], r["tfidf"]) for r in old.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    per = defaultdict(list)
    for (i, _), v in want.items():
        per[i].append(v[3])
    assert {i: v for i, v in sums.items()} == {i: pytest.approx((len(v), sum(v), max(v))) for i, v in per.items()}


def test_a_repeated_id_beyond_a_slice_is_grouped_by_rows(spark, monkeypatch):
    monkeypatch.setattr(SL, "SLICE_BYTES", 25)
    assert SL.plan(docs(spark), "id", "text") is None
    got = FE.term_profile(docs(spark), T.char_wb_ngrams)
    assert {r.id: (r.n, r.n_distinct) for r in got.collect()} == {i: (sum(c.values()), len(c)) for i, c in merged().items()}
    lone = docs(spark, [(i, t) for i, t in ROWS if i not in (4, None)])
    assert SL.plan(lone, "id", "text") >= 2


def test_empty_table(spark):
    none = docs(spark, [])
    assert FE.term_profile(none, T.char_wb_ngrams).count() == 0
    assert FE.fit_transform_tfidf(none, analyzer=T.char_wb_ngrams)[1].count() == 0


def test_grams_of_words():
    words = ["a", "aaaa", "漢字", "\U0001f600b"]
    off, number, grams = SL._word_grams(words)
    assert len(set(grams)) == len(grams) and math.prod(off.shape) == len(words) + 1
    for i, w in enumerate(words):
        assert sorted(grams[g] for g in np.asarray(number[off[i] : off[i + 1]])) == sorted(py_char_wb(w))


def test_matrix_packed_and_plain_are_one(spark, cut):
    """A packed term takes a byte for its count and four for its column; rows without terms are kept."""
    rows = [(i, t, i % 2, 1.0 + i) for i, (_, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "id long, text string, y int, w double")
    sliced = SL.sliced(df, 3, T.char_wb_ngrams, "id", "text", keep=("y", "w"))
    needs = SL.slice_terms(sliced, T.char_wb_ngrams)
    vocab = FE.dense_ids(FE.with_idf(FE._summed(needs, 2), len(rows)), ["term"], "tid")
    idf = {r.tid: r.idf for r in vocab.collect()}
    plain = {r.id: r for r in SL.matrix(sliced, needs, vocab, T.char_wb_ngrams, packed=False).collect()}
    assert plain.keys() == set(range(len(rows))) and {(r.y, r.w) for r in plain.values()} == {(y, w) for _, _, y, w in rows}
    got = {}
    for r in SL.matrix(sliced, needs, vocab, T.char_wb_ngrams, packed=True).collect():
        y, w, size, cols, tf, scale = SL.unpacked(*(pa.scalar(bytes(v), pa.binary()) for v in r[2:]))
        assert len(r["cols"]) + len(r["vals"]) == 5 * len(cols) + 1
        ends = np.cumsum(size)
        for a, b, one, f in zip(ends - size, ends, w, scale, strict=True):
            got[int(one - 1)] = (cols[a:b].tolist(), [n * idf[c] * f for n, c in zip(tf[a:b], cols[a:b], strict=True)])
    assert got.keys() == plain.keys()
    for i, (cols, vals) in got.items():
        assert cols == plain[i].cols and vals == pytest.approx(plain[i].vals)
        assert not vals or sum(v * v for v in vals) == pytest.approx(1)


def test_vectors_of_a_fit_stay_small_on_the_driver():
    assert 25 * 8 * CL.MAX_COEFFICIENTS < 300 << 20  # the point, the gradient, ten pairs of history
