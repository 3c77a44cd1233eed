"""JN-3 / JN-4: exact top-1 with the tie, zero-vector and threshold rules."""

import numpy as np
import pytest

from lexiflow.operators import memory as MEM
from lexiflow.operators import similarity as SIM


def _vecs(spark):
    mem = [
        (10, [1.0, 0.0, 0.0], 0),
        (11, [1.0, 0.0, 0.0], 1),  # exact duplicate of 10: tie -> lowest position (10)
        (12, [0.0, 0.0, 0.0], 2),  # zero vector never matches
        (13, [0.6, 0.8, 0.0], 3),
    ]
    return spark.createDataFrame(mem, "id long, vec array<double>, pos long")


@pytest.mark.parametrize("force", ["broadcast", "sharded"])
def test_dense_rules(spark, force):
    q = spark.createDataFrame(
        [(1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, [0.6, 0.8, 0.0])],
        "id long, vec array<double>",
    )
    res = {r.qid: (r.match_id, r.score) for r in MEM.VectorMemory(_vecs(spark), force=force).match(q).collect()}
    assert res["1"][0] == 10 and res["1"][1] == pytest.approx(1.0)
    assert res["2"][0] in (10, 13) and res["2"][1] == pytest.approx(0.0)  # orthogonal: score 0, lowest position wins
    assert res["3"] == (None, None)  # zero query never matches
    assert res["4"][0] == 13


def test_cosine_column_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=8), rng.normal(size=8)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    got = df.select(SIM.cosine("a", "b")).first()[0]
    assert got == pytest.approx(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))


def test_exclude_self_and_labels(spark):
    mem = spark.createDataFrame(
        [(1, [1.0, 0.0], 0, "x"), (2, [0.9, 0.1], 1, "y"), (3, [0.0, 1.0], 2, "x")],
        "id long, vec array<double>, pos long, label string",
    )
    m = MEM.VectorMemory(mem)
    loo = {r.qid: r.match_id for r in m.match(mem, exclude_self=True).collect()}
    assert loo == {"1": 2, "2": 1, "3": 2}
    same = {r.qid: r.match_id for r in m.match(mem, exclude_self=True, same_label=True).collect()}
    assert same == {"1": 3, "2": None, "3": 1}


@pytest.mark.parametrize("force", ["broadcast", "sharded"])
def test_text_memory_threshold_and_no_overlap(spark, force):
    entries = spark.createDataFrame(
        [(1, "break a leg", "bol şans", 0), (2, "bite the bullet", "dişini sık", 1), (3, "break a leg", "iyi şanslar", 2)],
        "mem_id long, text string, standard string, pos long",
    )
    mem = MEM.TextMemory(entries, force=force)
    q = spark.createDataFrame(
        [("a", "Break a leg!", 1.0), ("b", "zzz qqq", 2.0), ("c", "the bullet", 3.0)], "id string, text string, score double"
    )
    out = mem.match(q)
    assert out.columns == ["id", "text", "score", "mem_id", "mem_standard", "mem_score"]  # caller's score kept
    res = {r.id: (r.mem_id, r.mem_standard, r.mem_score) for r in out.collect()}
    assert res["a"][0] == 1 and res["a"][2] == pytest.approx(1.0)  # duplicate key: first position
    assert res["b"] == (None, None, None)  # no shared term: no candidate
    assert res["c"][0] == 2 and 0 < res["c"][2] < 1


def test_sharded_equals_broadcast_random(spark):
    rng = np.random.default_rng(1)
    mem = [(i, rng.normal(size=6).tolist(), i) for i in range(60)]
    qs = [(100 + i, rng.normal(size=6).tolist()) for i in range(25)]
    m = spark.createDataFrame(mem, "id long, vec array<double>, pos long")
    q = spark.createDataFrame(qs, "id long, vec array<double>")
    a = {r.qid: (r.match_id, round(r.score, 9)) for r in MEM.VectorMemory(m, force="broadcast").match(q).collect()}
    b = {r.qid: (r.match_id, round(r.score, 9)) for r in MEM.VectorMemory(m, force="sharded").match(q).collect()}
    M = np.array([v for _, v, _ in mem])
    M = M / np.linalg.norm(M, axis=1, keepdims=True)
    for qid, v in qs:
        s = M @ (np.array(v) / np.linalg.norm(v))
        assert a[str(qid)][0] == int(np.argmax(s))
    assert a == b


def test_scored_block_bounded_by_memory_size(spark):
    """A memory near the broadcast bound scores few queries per block, so the
    (queries x memory) score matrix stays near SCORE_BLOCK_BYTES."""
    big = {"kind": "dense", "pos": np.zeros(2_000_000, dtype=np.int64)}
    rows = SIM._block_rows(big, 512)
    assert 1 <= rows and rows * 8 * len(big["pos"]) <= SIM.SCORE_BLOCK_BYTES
    assert SIM._block_rows({"kind": "dense", "pos": np.zeros(10, dtype=np.int64)}, 512) == 512
    assert SIM._block_rows({"kind": "sparse", "pos": np.zeros(10**9, dtype=np.int64)}, 512) == 512
    assert SIM._block_rows({"kind": "dense", "pos": np.zeros(10**9, dtype=np.int64)}, 512) == 1


def test_dense_small_blocks_same_answer(monkeypatch):
    """One query per scored block gives the same winners as full blocks (kernel run
    in-process: the block bound is read where the scoring runs)."""
    import pandas as pd

    rng = np.random.default_rng(1)
    mv, qv = rng.normal(size=(40, 5)), rng.normal(size=(9, 5))
    mv[7] = mv[3]  # duplicate: tie goes to position 3
    qv[0] = mv[3]
    mem = pd.DataFrame({"pos": np.arange(40, dtype=np.int64), "vec": list(mv)})
    q = pd.DataFrame({"qid": [str(i) for i in range(9)], "vec": list(qv)})
    state = SIM._dense_state(mem)
    full = pd.concat(SIM._score_batches(state, [q], 512), ignore_index=True)
    monkeypatch.setattr(SIM, "SCORE_BLOCK_BYTES", 1)
    one = list(SIM._score_batches(state, [q], 512))
    assert len(one) == len(q)
    pd.testing.assert_frame_equal(pd.concat(one, ignore_index=True), full)
    assert full.loc[0, "match_pos"] == 3


@pytest.mark.parametrize("with_label", [False, True])
def test_text_memory_rowwise_equals_long_form(spark, with_label):
    """The broadcast memory scores rows in place (terms from the JVM analyzer, tf-idf
    in the kernel); the sharded memory goes through the long form.  Same answers,
    with and without the requested-label condition, null texts included."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(3)

    def text(n):
        return " ".join(rng.choice(words, size=n))

    entries = spark.createDataFrame(
        [(i, text(int(rng.integers(1, 6))), f"t{i}", i, "xy"[i % 2]) for i in range(30)],
        "mem_id long, text string, standard string, pos long, label string",
    )
    rows = [(f"q{i}", text(int(rng.integers(0, 8))), "xy"[i % 3 % 2]) for i in range(40)] + [("qn", None, "x")]
    q = spark.createDataFrame(rows, "id string, text string, requested_label string")
    label_col = "requested_label" if with_label else None

    def run(force):
        mem = MEM.TextMemory(entries, with_label=with_label, force=force)
        out = mem.match(q, label_col=label_col)
        assert out.columns == q.columns + ["mem_id", "mem_standard", "mem_score"]
        return {r.id: (r.mem_id, None if r.mem_score is None else round(r.mem_score, 9)) for r in out.collect()}

    a, b = run("broadcast"), run("sharded")
    assert a == b and len(a) == len(rows)
    assert a["qn"] == (None, None)


def test_sparse_kernel_equals_brute_force():
    """Candidate-only sparse scoring against a dense brute-force cosine argmax,
    with label and self-key conditions, duplicate entries (ties) and empty rows."""
    import pandas as pd

    rng = np.random.default_rng(7)
    vocab = np.array([f"w{i}" for i in range(25)])
    n_mem, n_q = 80, 60
    M = np.where(rng.random((n_mem, 25)) < 0.15, rng.random((n_mem, 25)), 0.0)
    M[5] = M[2]  # duplicate: the tie goes to the lower position
    M[9] = 0.0  # empty entry never matches
    Q = np.where(rng.random((n_q, 25)) < 0.2, rng.integers(1, 4, (n_q, 25)).astype(float), 0.0)
    Q[0] = M[2]
    labels = np.array(list("ab"))[rng.integers(0, 2, n_mem)]
    qlabels = np.array(list("ab"))[rng.integers(0, 2, n_q)]
    keys = np.array([f"k{i}" for i in range(n_mem)])
    qkeys = np.array([f"k{i}" if i % 4 == 0 else "none" for i in range(n_q)])

    def sparse(m):
        nz = [np.flatnonzero(r) for r in m]
        return [list(vocab[i]) for i in nz], [r[i] / (np.linalg.norm(r) or 1.0) for r, i in zip(m, nz)]

    mt, mw = sparse(M)
    mem = pd.DataFrame({"pos": np.arange(n_mem) * 10, "terms": mt, "ws": mw, "key": keys, "label": labels})
    state = SIM._sparse_state(mem.sample(frac=1.0, random_state=1))  # input order must not matter
    qt = [list(vocab[np.flatnonzero(r)]) for r in Q]
    qw = [r[np.flatnonzero(r)] for r in Q]
    q = pd.DataFrame({"qid": [str(i) for i in range(n_q)], "terms": qt, "ws": qw, "key": qkeys, "label": qlabels})
    got = SIM._best(state, q)

    Mn = M / np.where(np.linalg.norm(M, axis=1) > 0, np.linalg.norm(M, axis=1), 1.0)[:, None]
    for i in range(n_q):
        qn = np.linalg.norm(Q[i])
        s = Mn @ (Q[i] / qn) if qn > 0 else np.zeros(n_mem)
        s[(s <= 0) | (labels != qlabels[i]) | (keys == qkeys[i])] = -np.inf
        r = np.round(s, 12)
        if not np.isfinite(r.max()):
            assert pd.isna(got.loc[i, "match_pos"])
            continue
        assert got.loc[i, "match_pos"] == 10 * int(np.argmax(r))
        assert got.loc[i, "score"] == pytest.approx(s.max(), abs=1e-12)


def test_weigh_batch_counts_and_long_terms():
    """Chunk weighting: tf x idf over known terms in vocabulary order, unknown terms
    dropped, empty and null rows empty; a very long term is neither truncated nor
    allowed to widen the arrays (object strings, hash lookup)."""
    import pandas as pd

    long_term = "x" * 20_000
    vocab = pd.Index(sorted(["ab", "cd", long_term, "x" * 19_999]), dtype=object)
    idf = np.array([1.0, 2.0, 3.0, 4.0])[np.argsort(np.argsort(["ab", "cd", long_term, "x" * 19_999]))]
    idf_of = dict(zip(["ab", "cd", long_term, "x" * 19_999], [1.0, 2.0, 3.0, 4.0]))
    to_state = np.arange(len(vocab), dtype=np.int64)
    rows = [["cd", "ab", "cd", "zz"], None, [], [long_term + "y", long_term], ["zz"]]
    terms, ws, tids = SIM._weigh_batch(rows, vocab, idf, to_state)
    assert list(terms[0]) == ["ab", "cd"] and list(ws[0]) == [idf_of["ab"], 2 * idf_of["cd"]]
    assert len(terms[1]) == len(terms[2]) == len(terms[4]) == 0
    assert list(terms[3]) == [long_term] and list(ws[3]) == [idf_of[long_term]]
    assert list(tids[0]) == [vocab.get_loc("ab"), vocab.get_loc("cd")]


def test_sparse_many_shards_and_blocks_equal_broadcast(spark):
    """Sharded scoring with several memory shards and several query blocks (the
    block count from a caller's term bound) gives the broadcast answers."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(12)]

    def vec(k):
        t = sorted(set(rng.choice(words, size=k)))
        return t, [float(x) for x in rng.random(len(t)) + 0.1]

    mem = [(i, *vec(int(rng.integers(1, 5)))) for i in range(50)]
    qs = [(f"q{i}", *vec(int(rng.integers(1, 6)))) for i in range(40)]
    m = spark.createDataFrame(mem, "pos long, terms array<string>, ws array<double>")
    q = spark.createDataFrame(qs, "qid string, terms array<string>, ws array<double>")
    bcast = {r.qid: (r.match_pos, round(r.score, 9)) for r in SIM.nearest(q, m, "sparse", force="broadcast").collect()}
    prep = SIM.prepare(m, "sparse", shard_bytes=256, force="sharded")
    assert prep.n_shards > 1
    four_blocks = 4 * (64 << 20) // 72
    sharded = SIM.nearest(q, prep, "sparse", query_nnz=four_blocks)
    got = {r.qid: (r.match_pos, None if r.score is None else round(r.score, 9)) for r in sharded.collect()}
    assert got == bcast
