"""Collocations against a brute-force count, at several sizes of filters, and SQL on a small table."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lexiflow.llm import collocations as L


def brute(rows, least, most=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [q for (g, q), b in f.items() if g == lang and len(q) > len(p) and b >= least and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if longer:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s))
    return sorted((lang, i + 1, r[2].decode(), *r[3:]) for lang, rs in out.items() for i, r in enumerate(sorted(rs)[:top]))


def texts(seed=1):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "gamma", "naïve", "日本", "d'or", "x\x0by", "é", "10", "A\x1cB"]
    out = []
    for k in range(60):
        words = [rng.choice(vocab[: rng.choice([3, 10])]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words) + 1) : 0] = ["New", "York", "stock", "exchange"]
        out.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ""]) for w in words), ["en", "en", "de", None, "und"][k % 5]))
    return [*out, (None, "en"), ("", None), (" . , ", "fr"), ("same same " * 200, "fr"), *[("uno due tre!", "it")] * 7, out[0], out[0]]


ROWS = texts()


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, lang, i, "n") for i, (t, lang) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, a long, Word string").repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"bucket_entries": 50, "held_entries": 40}, {"max_broadcast": 2, "bucket_entries": 300}])
def test_equals_brute_force(frame, sizes):
    got = sorted(tuple(r) for r in L.mine(frame, min_count=6, **sizes).collect())
    want = brute(ROWS, 6)
    assert got == want and len({r[0] for r in want}) == 5
    assert any(r[2] == "new york stock exchange" for r in got)
    held = [r[2] for r in got if r[0] == "it"]
    assert held == ["uno due tre"]  # its parts are as frequent and go


def test_top_ranks_are_those_of_all(frame, monkeypatch):
    monkeypatch.setattr(L, "GROUP_ROWS", 3)
    got = sorted(tuple(r) for r in L.mine(frame, min_count=4, max_words=3, top=5).collect())
    assert got == brute(ROWS, 4, 3, 5)


def test_pair_vector_holds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BITS", 6)
    pairs = [(i, (7 * i) % 90) for i in range(90)]
    frame = spark.createDataFrame([(list(p), 9) for p in pairs], "ids array<long>, a long")
    bits, vector = L.pair_vector(frame, 7)
    assert len(vector) * 8 == 1 << bits and np.unpackbits(vector).sum() <= 90
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    chain = np.stack([a, b, np.full(90, 126)], 1).ravel()
    got = L._occupied(bits, vector, chain, np.ones(len(chain) - 1, bool), 7)
    assert got[::3].all() and got.sum() < 90 + 60
    tiny = spark.createDataFrame([([0, 1], 9)], "ids array<long>, a long")
    assert L.pair_vector(tiny, 1)[0] == 2


def test_scores_beyond_64_bits(spark):
    big = 10**15
    phrases = spark.createDataFrame([("en", ["u", "v"], big)], "lang string, words array<string>, a long")
    words = spark.createDataFrame([("en", "u", big), ("en", "v", big + 1)], "lang string, word string, n long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    r = L.scored(phrases, words, totals).first()
    assert r.score == 1000 * big * 9 * big // (big * (big + 1))


def test_limits_and_empty_table(spark, tmp_path, frame, monkeypatch):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert L.query(spark, str(tmp_path)).collect() == []
    monkeypatch.setattr(L.cqf, "MAX_BITS", 8)
    with pytest.raises(ValueError):
        L.mine(frame, min_count=2)
    with pytest.raises(ValueError):
        L.mine(frame, max_words=1)
