"""JN-3 pruned search: equal to a brute-force search, and few shards visited where vectors cluster."""

import numpy as np
import pytest

from lexiflow.operators import memory as MEM
from lexiflow.operators import pruned as PR
from lexiflow.operators import similarity as SIM


def clustered(rng, n, d=16, groups=12, spread=0.05):
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))


def frame(spark, vecs, start=0):
    rows = [(start + i, v.tolist(), start + i, "x" if i % 3 else "y") for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "id long, vec array<double>, pos long, label string").repartition(3)


def both(spark, mem, q, exclude_self, same_label=False, **kw):
    m = mem.select("pos", "vec", mem["id"].alias("match_id"), mem["id"].cast("string").alias("key"), "label")
    qq = q.select(q["id"].alias("qid"), "vec", q["id"].cast("string").alias("key"), "label")
    index = PR.PivotIndex(m, exclude_self, same_label, carry=("match_id",), **kw)
    got = {r.qid: r for r in index.nearest(qq, block_bytes=1 << 12).collect()}
    want = {r.qid: r for r in SIM.nearest(qq, SIM.prepare(m, "dense", exclude_self, same_label, force="broadcast", carry=("match_id",)), exclude_self=exclude_self, same_label=same_label).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k].match_id == w.match_id and got[k].match_pos == w.match_pos
        assert (got[k].score is None) == (w.score is None) and (w.score is None or got[k].score == pytest.approx(w.score, abs=1e-12))
    return index, got


def test_clustered_vectors_visit_few_shards(spark):
    rng = np.random.default_rng(1)
    vecs = clustered(rng, 900)
    vecs[100:160] = vecs[100]  # equal rows: ties go to the lowest position
    vecs[7] = 0
    index, got = both(spark, frame(spark, vecs), frame(spark, clustered(rng, 200)), False, shard_bytes=16 * 8 * 40, n_pivots=24)
    visited = np.array([r.visited for r in got.values()])
    assert index.n_shards >= 20
    assert visited.mean() < index.n_shards / 2 and visited.max() <= index.n_shards
    blocks = -(-200 * 16 * 8 // (1 << 12))
    assert index.copies < index.n_shards * blocks  # copies of the sharded strategy


@pytest.mark.parametrize("same_label", [False, True])
def test_spread_vectors_leave_one_out(spark, same_label):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(250, 6))
    vecs[3] = 0
    vecs[40:70] = vecs[40] * rng.uniform(0.5, 2, size=(30, 1))
    mem = frame(spark, vecs)
    both(spark, mem, mem, True, same_label, shard_bytes=6 * 8 * 20)


def test_small_empty_and_zero(spark):
    one = frame(spark, np.array([[1.0, 0.0]]))
    none = one.where("id < 0")
    index, got = both(spark, one, frame(spark, np.array([[0.0, 0.0], [2.0, 2.0]]), 5), False)
    assert got["5"].match_id is None and got["6"].match_id == 0 and index.n_shards == 1
    empty = PR.PivotIndex(none.select("pos", "vec"))
    r = empty.nearest(one.select(one["id"].alias("qid"), "vec")).first()
    assert r.match_pos is None and r.visited == 0
    assert PR.PivotIndex(one.select("pos", "vec")).nearest(none.select(none["id"].alias("qid"), "vec")).count() == 0


def test_vector_memory_prunes_beyond_the_broadcast_bound(spark):
    rng = np.random.default_rng(3)
    mem = frame(spark, clustered(rng, 120, 8, 4))
    small = {r.qid: (r.match_id, r.match_pos) for r in MEM.VectorMemory(mem).match(mem, exclude_self=True).collect()}
    large = MEM.VectorMemory(mem, max_broadcast_bytes=100).match(mem, exclude_self=True)
    assert large.columns == ["qid", "match_pos", "score", "match_id"]
    assert {r.qid: (r.match_id, r.match_pos) for r in large.collect()} == small
