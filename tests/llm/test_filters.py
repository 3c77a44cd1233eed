"""Line field rules, language filters and SimHash against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from lexiflow.llm import langid, linecrf, simhash

from .conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(zip(w, w[1:], w[2:]))  # noqa: B905
    cover = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for j in (i, i + 1, i + 2)}  # noqa: B905
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    sym = sum(text.count(x) for x in "#*$%&|<>")
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return (len(w), sum(map(len, w)), sym, dup, len(cover), failed)


def test_rules_counts_and_verdicts(spark, sf_dir):
    got = linecrf.query(spark, sf_dir).collect()
    want = Counter((r[0], *base(r[1])) for r in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    passed = {r.doc_id for r in got if not r.base_failed}
    assert not kept - passed
    assert {i for i in range(60) if i in passed} <= kept  # clean documents stay
    assert not kept & set(range(60, 72))  # junk goes


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    field = linecrf.LineField(rng.normal(size=linecrf.N_FEATURES), rng.normal(size=(2, 2)))
    sizes = [1, 3, 0, 7, 5]
    x = rng.integers(0, 2, (sum(sizes), linecrf.N_FEATURES)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = field.viterbi(x, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n == 0:
            continue

        def value(y, a=a, n=n):
            e = sum(x[a + t] @ field.emit for t in range(n) if y[t])
            return e + sum(field.move[y[t], y[t + 1]] for t in range(n - 1))

        every = [[(k >> t) & 1 for t in range(n)] for k in range(2**n)]
        assert abs(value(list(got[a:b])) - max(map(value, every))) < 1e-6


def test_field_gradient_climbs_the_likelihood():
    rng = np.random.default_rng(2)
    n = 200
    y = (np.cumsum(rng.random(n) < 0.1) % 2).astype(np.int64)
    x = rng.integers(0, 2, (n, linecrf.N_FEATURES)).astype(np.uint8)
    x[:, 0], x[:, 1] = 1, y
    first = np.arange(0, n + 1, 20)
    field = linecrf.LineField.fit(x, y, first)
    assert (field.viterbi(x.astype(np.float32), first) == y).mean() > 0.97
    assert field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0]  # runs are learned


def test_rules_stage_keeps_columns_and_label_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = linecrf.stage(spark, d, sf_dir)
    assert out.columns == d.columns
    field = linecrf.train(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    lines = linecrf.label_lines(d, field).where("id = 0").orderBy("line_no").collect()
    want = [len(WORD.findall(x)) for x in ROWS[0][1].split("\n")]
    assert [r.n_words for r in lines] == want


def test_empty_tables(spark, empty_dir):
    assert linecrf.query(spark, empty_dir).count() == 0
    assert langid.query(spark, empty_dir).count() == 0
    assert simhash.query(spark, empty_dir).count() == 0


def test_language_prediction(spark, sf_dir):
    got = langid.query(spark, sf_dir).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    texts = {r[0]: r for r in ROWS}
    for i in range(60):
        assert by[i].lang_pred == texts[i][2]
    for i, r in texts.items():
        if r[1] is None or not any(c.isalpha() for c in r[1]):
            assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
        else:
            assert by[i].lang_pred in ("en", "de")
        assert 0 <= by[i].score <= 1


def test_filters_contain_what_they_hold():
    rng = np.random.default_rng(3)
    gram = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for n_langs in (3, 20, 70):
        langs = [f"l{i:02}" for i in range(n_langs)]
        of = rng.integers(0, n_langs, len(gram))
        f = langid.LanguageFilters.build(langs, of, gram, 0)
        n = f.popcounts(gram, np.arange(len(gram)), len(gram))
        assert (n[np.arange(len(gram)), of] == 1).all()  # no false negatives
        other = rng.integers(0, 2**63, 20000, dtype=np.uint64)
        wrong = f.popcounts(other, np.zeros(len(other), np.int64), 1)[0] / len(other)
        assert np.abs(wrong - f.wrong).max() < 0.01  # the correction is the true rate


def test_grams_do_not_span_documents():
    a = langid.grams(pa.array(["abc", "def"]))[0]
    b = np.concatenate([langid.grams(pa.array([t]))[0] for t in ("abc", "def")])
    assert sorted(a.tolist()) == sorted(b.tolist())


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(u):
        for y in u[i + 1 :]:
            if (x ^ y).bit_count() <= distance:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in fps]


def test_simhash_query(spark, sf_dir):
    got = simhash.query(spark, sf_dir).collect()
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    root = brute_components(fps)
    least = {}
    for r, g in zip(ROWS, root, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(g)) for r, f, g in zip(ROWS, fps, root, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_ball_links_find_every_pair(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(12):  # chains and balls around each centre
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                c ^= 1 << b
            fps.add(c)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = brute_components(fps)
    for p in (0, 3, 9):
        nodes = {r.node: r.root for r in simhash.components(simhash.links(df, p)).collect()}
        got = [nodes.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_meet_splits_under_the_memory_bound(monkeypatch):
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 12, 200, dtype=np.uint64))
    left = np.full(len(fp), 2)
    whole, parts = [], []
    simhash.meet(fp, left, 12, whole)
    monkeypatch.setattr(simhash, "MAX_VARIANTS", 500)
    simhash.meet(fp, left, 12, parts)
    f = lambda e: {tuple(x) for x in simhash.forest(np.concatenate(e)).tolist()}
    assert f(whole) == f(parts)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 2000 + i) for i in range(300)]
    nodes = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert len({nodes[i] for i in range(301)}) == 1
    assert len({nodes[1000]} | {nodes[2000 + i] for i in range(300)}) == 1
    assert nodes[0] != nodes[1000]


def test_simhash_stage_keeps_one_of_each_group(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash.stage(spark, d, sf_dir)
    assert out.columns == d.columns
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    root = brute_components(fps)
    kept = Counter(brute_components([brute_fingerprint(r.text) for r in out.collect()]))
    assert sum(kept.values()) == len(set(root))
