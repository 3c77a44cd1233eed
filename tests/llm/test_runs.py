"""Periodic runs against a brute-force search over all lags and places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiflow.llm import runs as R


def brute(words, least=R.MIN_LENGTH):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            e = i
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - i + q >= max(least, 2 * q):
                found.setdefault((i - q, e), q)  # smaller lags come first
            i = e
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fast(docs):
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    code = np.array([w for d in docs for w in d], np.int64)
    out = [[] for _ in docs]
    for d, s, n, q in zip(*(x.tolist() for x in R.find_runs(code, first)), strict=True):
        out[d].append((s, n, q))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 90), st.integers(1, 25), st.integers(0, 10**6)), min_size=1, max_size=4))
def test_equals_brute_force(specs):
    docs = []
    for letters, n, p, seed in specs:
        rng = random.Random(seed)
        unit = [rng.randrange(letters) for _ in range(p)]
        doc = [rng.randrange(letters) for _ in range(n)] + unit * rng.randrange(6) + unit[: rng.randrange(p)] + [rng.randrange(letters) for _ in range(n // 2)]
        for _ in range(rng.randrange(3)):
            if doc:
                doc[rng.randrange(len(doc))] = 7
        docs.append(doc)
    assert fast(docs) == [brute(d) for d in docs]


def test_one_word_and_nested_periods_stay_small():
    """A document of one word has as many lags as words; the pairs of an octave do not square."""
    docs = [[5] * 50_000, ([1] * 30 + [2]) * 200, [], [1], [3] * 11, [3] * 12]
    got = fast(docs)
    assert got[0] == [(0, 50_000, 1)] and got[2] == got[3] == got[4] == [] and got[5] == [(0, 12, 1)]
    assert got[1] == brute(docs[1])
    code = np.zeros(50_000, np.int64)
    first = np.array([0, 50_000])
    names = R.Names(code, first)
    lag, start, end = R.diagonals(names, first, 256, 512, 1024)
    assert len(lag) == 512 and (end - start == 50_000 - lag).all()
    with pytest.raises(ValueError):
        R.find_runs(code, first, 5)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "naïve", "日本", "d.", "e"]) for _ in range(rng.randrange(120))) for _ in range(90)]
    texts += [None, "", " \n\t", "x" * 5000, "x " * 700, "one\ttwo\x0bthree  four " * 9, "one two three four " * 2]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "no id " * 8, "z"), (3, texts[3], "z"), (3, texts[3], "z")]
    spark.createDataFrame(rows, "doc_id long, text string, periodic string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = R.query(spark, str(tmp_path))
    got = sorted((tuple(r)[:8] for r in out.collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert any(r[1] for r in got) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(90)) > 3


def test_extra_columns_pass_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "k v " * 9, {"a": 1})], "Runs int, text string, n_words map<string,int>")
    r = R.annotate_runs(df, into="found").first()
    assert r.Runs == 1 and r.n_words == {"a": 1} and r.found.collapsed == "k v" and [tuple(x) for x in r.found.runs] == [(0, 18, 2)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert R.query(spark, str(tmp_path)).collect() == []
