"""Packing: ids equal the library's, every id in one piece, no padding, neighbours by BM25."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from lexiflow.llm import packing as K

FILE = K.read_file(public_tokenizers.path("byte_bpe_50k.json"))
TOK = Tokenizer.from_str(FILE)
ODD = ["don't <|endoftext|> naïve ÀÉÎ × ÷ 日本語 ½", "a\x0bb\x85c d   x", "tab\tnl\n\n  end  ", "", None, "x" * 9000, "<| endoftext |>", "é Ǆ ٣ 🙂", "it's WE'LL 're"]


def want(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library():
    rng = random.Random(9)
    signs = ["a", "B", "é", "ß", "1", "'s", "'LL", ".", "!?", " ", " ", " ", "  ", "\n", "\t", "\r", "<|endoftext|>", "日", "\x0b", "_", "×", "word", " the"]
    texts = ["".join(rng.choice(signs[: rng.choice([16, 23])]) for _ in range(rng.randrange(60))) for _ in range(800)]
    enc = K.Encoder(FILE)
    assert enc.fast is not None
    for a in range(0, 800, 100):
        ids, off = enc.encode(pa.array(texts[a : a + 100]), 0)
        assert [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:])] == [want(t) for t in texts[a : a + 100]]
    enc.fast = None
    ids, off = enc.encode(pa.array(["a b", ""]), 0)
    assert ids.tolist() == [*want("a b"), 0]


def check(rows, pieces, window=1024):
    """Pieces of all documents (by id) tile them, and sequences are gapless and full."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, text in rows:
        ids, at = want(text), 0
        for p in sorted(by_doc.pop(i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    assert not by_doc
    short = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window and at & (at - 1) == 0
        short += at < window
    return short


@pytest.mark.parametrize("shard", [2_000, K.SHARD_TOKENS])
def test_every_id_in_one_piece(spark, shard):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["haanth", "reoush", "über", "ning", "die", "the."]) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = list(enumerate([*texts, *ODD, *[texts[0]] * 40]))
    df = spark.createDataFrame([(i, t, i, "x", 1) for i, t in rows], "doc_id long, text string, row long, ids string, H0 int").repartition(3)
    pieces = K.pack(df, FILE, shard_tokens=shard).collect()
    short = check(rows, pieces)
    if shard == K.SHARD_TOKENS:
        assert short <= 9
    again = K.pack(df, FILE, shard_tokens=shard, window=64).collect()
    check(rows, again, 64)


def test_null_and_repeated_ids_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "d"), (4, "d")], "doc_id long, text string")
    got = K.pack(df, FILE).collect()
    assert sorted((str(p.id), p.doc_tokens) for p in got if p.start == 0) == [("4", 2)] * 2 + [("None", 4)] * 2
    assert sum(p.length for p in got) == 12
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert K.query(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError):
        K.pack(df, FILE, window=1000)


def test_query_digests(spark, tmp_path):
    rows = list(enumerate(ODD))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for p in K.query(spark, str(tmp_path)).collect():
        ids = want(ODD[p.doc_id])
        part = np.array(ids[p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids)


def brute_bm25(docs, idf, mean, d):
    out = []
    for other in docs:
        s = 0.0
        for t in set(docs[d]):
            tf = other.count(t)
            s += idf[t] * tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * len(other) / mean)) if tf else 0.0
        out.append(s)
    return out


def test_scores_equal_bm25_and_neighbours_come_best_first():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(1, 60)).tolist() for _ in range(50)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=40)
    idf = K.idf_of(df, len(docs))
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index = K.Index(np.concatenate(docs), off, idf, off[-1] / len(docs))
    size = np.diff(off).tolist()
    for d in range(50):
        wanted = brute_bm25(docs, idf, off[-1] / len(docs), d)
        got = index.scores(d)
        # terms of this document alone are left out: they score no other
        assert np.allclose(np.delete(got, d), np.delete(wanted, d))
        unused = np.ones(50, bool)
        unused[d] = False
        near = K._neighbours(index, d, unused, 100, size)[::-1]
        best = sorted((i for i in range(50) if i != d and got[i] > 0), key=lambda i: (-got[i], i))
        assert near == best[: len(near)] and (len(near) == len(best) or sum(size[i] for i in near) >= 100)


def test_a_window_holds_the_seeds_neighbours():
    """Two topics in one shard: every window but one is of one topic."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(100 * (k % 2), 100 * (k % 2) + 100, 30) for k in range(40)]
    off = np.concatenate([[0], np.cumsum([30] * 40)])
    idf = K.idf_of(np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=200), 40)
    pieces = K.pack_shard(off, K.Index(np.concatenate(docs), off, idf, 30.0), 128)
    topics = {}
    for doc, _, _, seq, _ in pieces:
        topics.setdefault(seq, set()).add(doc % 2)
    assert sum(len(t) == 2 for t in topics.values()) <= 1
    assert sorted({p[0] for p in pieces}) == list(range(40))


def test_signature_groups_by_rare_ids_and_one_posting_table_per_vocabulary(spark):
    df = spark.createDataFrame([(i, f"common words and topic{i % 3} again") for i in range(30)], "doc_id long, text string")
    rows = K.encoded(df, FILE, 50_257)
    freq = K.document_frequency(rows, 50_257)
    assert freq[0] == 30 and freq.max() == 30 and len(freq) == 50_257
    assert sum(1 for x in freq if 0 < x < 30) == 3
    assert K.idf_of(freq, 30)[0] == 0
