"""Mixing, BPE lexicon and wavelet shards."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexiflow.llm import lexicon, mixing, pieces, wavelet

from .conftest import ROWS

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    "", "  ", "<|endoftext|>x<|startoftext|>", "don't I'll İstanbul ŒUVRE", "été ＡＢＣ ½ Σίσυφος ΌΣΟΣ", "日本語テキスト 123 一二",
    "a b c\x85d\x1ce", "x" * 300, "é×÷ß ÀÉ", "\U0001F600 ok \U0001F468‍\U0001F469", "'s'S 's ''re", "<|endoftext",
    "ﬁ ŉ ǅ ª º µ ²", "12 3a4 $5.00%%", "abc̀def﻿", "ͅ ẞ İ K Å", "नमस्ते दुनिया", "\x00\x01 a\x7fb",
]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


def capped(sizes, weights, total):
    """Targets by halving intervals on the common factor."""
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < total:
            lo = mid
        else:
            hi = mid
    return [min(2 * s, hi * w) for s, w in zip(sizes, weights, strict=True)]


def test_mix(spark, sf_dir):
    got = mixing.query(spark, sf_dir).collect()
    size = [len(WORD.findall(r[1] or "")) for r in ROWS]
    by = defaultdict(int)
    for r, n in zip(ROWS, size, strict=True):
        by[r[3]] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, capped([by[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size)), strict=True))
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((r[0], n, by[r[3]]) for r, n in zip(ROWS, size, strict=True))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target] += r.taken
    for s in order:
        t = next(r.target for r in got if abs(r.target - goal[s]) < 1e-3)
        assert abs(taken[t] - goal[s]) <= 2 * mixing.BLOCK + 0.01 * goal[s]
    again = mixing.query(spark, sf_dir).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_stage_meets_the_targets_in_whole_documents(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", "abc"[i % 3] if i % 4 else "a", 0) for i in range(3000)]
    d = spark.createDataFrame([*rows, (3000, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.stage(spark, d, "")
    assert out.columns == d.columns
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    goal = dict(zip("abc", capped([size[s] for s in "abc"], [3, 1, 2], 1.5 * sum(size.values())), strict=True))
    got, times = Counter(), Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    assert all(abs(got[s] - goal[s]) < 0.06 * goal[s] for s in "abc")
    assert max(times.values()) <= 2 and 3000 not in times


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(50):
        votes = (rng.random(6) * rng.choice([1, 10, 1000], 6)).tolist()
        seats, most = int(rng.integers(0, 400)), rng.integers(1, 300, 6).tolist()
        seats = min(seats, sum(most))
        pool = sorted((-v / (2 * k + 1), i, k) for i, (v, m) in enumerate(zip(votes, most, strict=True)) for k in range(m))
        want = [0] * 6
        for _, i, _ in pool[:seats]:
            want[i] += 1
        assert mixing.sainte_lague(votes, seats, most) == want


def test_sainte_lague_of_many_sources():
    """Small shares that round up: highest quotients leave the large source fewer seats."""
    votes, most = [1000.0] + [0.6] * 1000, [10_000] * 1001
    got = mixing.sainte_lague(votes, 1600, most)
    pool = sorted((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(1001 if i == 0 else 3))
    want = [0] * 1001
    for _, i in pool[:1600]:
        want[i] += 1
    assert got == want and got[0] == 833
    rng = np.random.default_rng(3)
    for seats in (1, 999, 5000):
        votes, most = (rng.random(1000) ** 4 * 50).tolist(), rng.integers(0, 30, 1000).tolist()
        seats = min(seats, sum(most))
        pool = sorted((-v / (2 * k + 1), i) for i, (v, m) in enumerate(zip(votes, most, strict=True)) for k in range(m))
        want = [0] * 1000
        for _, i in pool[:seats]:
            want[i] += 1
        assert mixing.sainte_lague(votes, seats, most) == want


def test_documents_without_a_word_reach_no_shard(spark, monkeypatch):
    groups = spark.sparkContext.accumulator(0)
    choose = mixing.choose
    monkeypatch.setattr(mixing, "choose", lambda pdf, seed: groups.add(len(pdf)) or choose(pdf, seed))
    rows = [(i, "", "a" if i % 2 else None) for i in range(500)] + [(900, "some words here", "a"), (901, " ", "only empty")]
    got = {r.id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == 502 and groups.value == 1
    assert got[900].taken > 0 and got[3].taken == 0 and got[3].source_size == 3
    assert got[901].size == 0 and got[901].source_size == 0 and got[901].target == 0


def test_many_shards_still_meet_the_targets(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    got = mixing.query(spark, sf_dir).collect()
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target] += r.taken
    for t, n in taken.items():
        assert abs(n - t) <= 64 + 0.05 * t


def test_mix_and_codes_of_empty_tables(spark, empty_dir):
    assert mixing.query(spark, empty_dir).count() == 0
    assert lexicon.query(spark, empty_dir).count() == 0
    assert wavelet.query(spark, empty_dir).count() == 0


def test_bpe_equals_the_library(spark, sf_dir, tok):
    got = lexicon.query(spark, sf_dir).collect()
    want = Counter()
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(r[0], len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(map(tuple, got)) == want


def test_odd_texts_both_ways(tok):
    file = lexicon.default_file()
    library = wavelet.LibraryEncoder(file)
    own = lexicon.Encoder(file, lexicon.Transducer.compile([b"ok", b"a"], [[1, 2], [3]][:0] or [tok.encode(w).ids for w in ("ok", "a")]))
    for enc in (library, own):
        ids, off = enc(pa.array(ODD))
        for k, s in enumerate(ODD):
            assert ids[off[k] : off[k + 1]].tolist() == tok.encode(s, add_special_tokens=False).ids, s


def test_fast_path_agrees_on_every_latin_character(tok):
    texts = [chr(c) + x for c in range(0x250) for x in ("", "a", "A b", "1")] + ["a" + chr(c) for c in range(0x250)]
    vocab = pieces.Vocabulary(lexicon.default_file())
    enc = lexicon.Encoder(lexicon.default_file(), lexicon.Transducer.compile([], []))
    ids, off = enc(pa.array(texts))
    for k, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[off[k] : off[k + 1]].tolist() == e.ids, repr(texts[k])
    assert vocab.none == len(vocab.merged)


def test_transducer_numbers_words_and_shares_suffixes(tmp_path):
    words = [a + b for a in (b"run", b"walk", b"talk") for b in (b"", b"s", b"ing", b"ed")]
    t = lexicon.Transducer.compile(words, [[i, i + 1] for i in range(len(words))])
    path = str(tmp_path / "x.bin")
    t.save(path)
    t = lexicon.Transducer.open(path)
    probe = [*words, b"", b"runn", b"walke", b"zzz", b"x" * 99]
    number = t.find(pa.array(probe, pa.binary()))
    assert number[len(words) :].tolist() == [-1] * 5
    for w, n in zip(words, number, strict=False):
        i = words.index(w)
        assert t.ids[t.id_start[n] : t.id_start[n + 1]].tolist() == [i, i + 1]
    assert len(t.final) < 24  # a trie has more states


def test_decode_defined_results(spark):
    file = lexicon.default_file()
    df = spark.createDataFrame([(1, [320, 10**6, 49407]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in lexicon.decode(df, file).collect()}
    t = pieces.Vocabulary(file).tokens
    assert got == {1: f"{t[320]} <|endoftext|>", 2: "", 3: None}


def test_wavelet_matrix_operations():
    rng = np.random.default_rng(2)
    for top, n in ((5, 3000), (50000, 4097), (1, 10), (2**20, 700)):
        x = rng.integers(0, top, n)
        payload = wavelet.pack([7, None], np.array([n - 1, 1]), wavelet.WaveletMatrix.build(x))
        names, sizes, wm = wavelet.unpack(payload)
        assert names == [7, None] and sizes.tolist() == [n - 1, 1]
        assert (wm.decode() == x).all()
        for i in rng.integers(0, n, 20).tolist():
            assert wm.access(i) == x[i]
        for t in [*x[:10].tolist(), 10**7]:
            at = np.flatnonzero(x == t)
            assert wm.count(t) == len(at)
            assert wm.rank(t, n // 2) == (at < n // 2).sum()
            assert wm.occurrences(t)[:50].tolist() == at[:50].tolist()


def test_shards_round_trip(spark, docs, tok, tmp_path):
    path = str(tmp_path / "shards")
    file = lexicon.default_file()
    wavelet.write_shards(docs, path, file, shard_ids=2000)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    got = wavelet.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in order]
    want = Counter()
    for r in ROWS:
        want[(r[0], zlib.crc32(np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in got) == want
    ends = np.cumsum([len(r.ids) // 4 for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    whole = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4")
    assert spark.read.parquet(path).count() > 5
    for t in (1, int(whole[5])):
        assert wavelet.count(spark, path, t) == (whole == t).sum()
        at = sorted(r.position for r in wavelet.lookup(spark, path, t).collect())
        assert at == np.flatnonzero(whole == t).tolist()


def test_planes_move_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    for top, n in ((1, 1), (2, 64), (50000, 1000), (2**20, 129), (1, 0)):
        x = rng.integers(0, top, n)
        wm = wavelet.WaveletMatrix.build(x)
        order = x
        for k, b in enumerate(range(len(wm.planes) - 1, -1, -1)):
            bit = (order >> b) & 1
            assert (np.unpackbits(wm.planes[k], count=n) == bit).all() and wm.zeros[k] == (bit == 0).sum()
            order = np.concatenate([order[bit == 0], order[bit == 1]])
        assert (wm.decode() == x).all()


def test_pieces_reach_the_library_without_a_step_of_python_each(tok, monkeypatch):
    """Signs, joins and ids are arrays; a piece that is remembered is not asked again."""
    monkeypatch.setattr(pieces, "is_odd", None)
    enc = wavelet.LibraryEncoder(lexicon.default_file())
    asked = []
    library = enc._library
    enc._library = lambda p: asked.append(p.to_pylist()) or library(p)
    words = [f"w{chr(97 + i % 26) * (i % 40)}x{chr(97 + i // 26 % 26)}" for i in range(2000)]
    for batch in (words, [*words, "été", "don't", ""], [*ODD, *words], [], [""]):
        ids, off = enc(pa.array(batch, pa.string()))
        for k, s in enumerate(batch):
            assert ids[off[k] : off[k + 1]].tolist() == tok.encode(s, add_special_tokens=False).ids, s
    assert asked[1] == ["été".encode(), b"don't"] and len(asked[0]) > 1000
    assert not asked[3] and not asked[4]


def test_odd_pieces_of_an_array():
    at = [*ODD, "<", "|", "a<", "|b", "Ã", "é", "ß", "×", "÷", "À", "'", "x'y", "\x00", "¡", "a½"]
    raw = [p for t in at for p in (t.encode(), *pieces.cut(pa.array([t]))[0].to_pylist())]
    for batch in (raw, raw[5:], [b"", *raw, b""], [b""], []):
        assert pieces.odd(pa.array(batch, pa.binary())).tolist() == [pieces.is_odd(p) for p in batch]


def test_a_worker_makes_one_encoder_for_all_its_tasks(spark, docs):
    from lexiflow.llm import common

    common.prepare(spark)
    wavelet.encoded(docs.repartition(48), lexicon.default_file()).write.format("noop").mode("overwrite").save()

    def state(batches):
        for batch in batches:
            info = wavelet.worker_encoder.cache_info()
            yield pa.RecordBatch.from_arrays([pa.array([info.misses]), pa.array([info.hits])], names=["misses", "hits"])

    got = spark.range(0, 48, 1, 48).mapInArrow(state, "misses long, hits long").collect()
    assert max(r.misses for r in got) == 1 and max(r.hits for r in got) > 0
