"""Dense searches: pairs are cut for all task slots, equal keys are found by number, ties as rounded;
the texts of a stream arrive in files of one size."""

import numpy as np
import pandas as pd
import pytest

from lexiflow.operators import pruned as PR
from lexiflow.operators import similarity as SIM
from lexiflow.plans import q_stream as QS


def test_first_best_is_that_of_rounded_scores():
    rng = np.random.default_rng(4)
    s = rng.integers(-3, 4, size=(300, 40)) / 8 + rng.choice([0, 4e-13, -4e-13, 6e-13, 1.2e-12], size=(300, 40))
    s[5] = -np.inf
    s[6, 3] = np.nan
    s[7, :20] = -np.inf
    assert np.array_equal(SIM._first_best(s), np.argmax(np.round(s, SIM.TIE_DECIMALS), axis=1))


@pytest.mark.parametrize("label", [False, True])
def test_keys_and_labels_by_number(label):
    rng = np.random.default_rng(5)
    keys, labels = [None, "a", "b", "b", "c", float("nan")] * 6, ["x", None, "y"] * 12
    mem = pd.DataFrame({"pos": np.arange(36), "vec": list(rng.normal(size=(36, 4))), "key": keys, "label": labels})
    q = pd.DataFrame({"qid": [str(i) for i in range(8)], "vec": list(rng.normal(size=(8, 4))), "key": ["a", "b", None, "zz", "c", "b", "a", None], "label": ["x", "y", None, "w", "x", "y", "y", "x"]})
    got = SIM._best(SIM._dense_state(mem), q if label else q.drop(columns="label"))
    m = np.stack(mem["vec"])
    for i, r in q.iterrows():
        ok = np.array([not (k == r.key and k is not None) and (not label or (lab is not None and lab == r.label)) for k, lab in zip(keys, labels, strict=True)])
        s = np.where(ok, m @ r.vec / np.linalg.norm(m, axis=1) / np.linalg.norm(r.vec), -np.inf)
        assert (got.match_pos[i] is pd.NA) == (not ok.any()) and (not ok.any() or (got.match_pos[i] == s.argmax() and got.score[i] == pytest.approx(s.max())))


def test_pairs_are_cut_for_all_slots(spark, monkeypatch):
    """A memory that fits one shard is still cut, and the answer is the same."""
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(400, 4))
    vecs[30:40] = vecs[30]
    rows = spark.createDataFrame([(i, v.tolist(), i, str(i)) for i, v in enumerate(vecs)], "qid long, vec array<double>, pos long, key string")
    want = {r.qid: (r.match_pos, round(r.score, 9)) for r in SIM.nearest(rows, SIM.prepare(rows, exclude_self=True, force="broadcast"), exclude_self=True).collect()}
    monkeypatch.setattr(SIM, "TILE_LEAST", 16)
    prep = SIM.prepare(rows, exclude_self=True, force="sharded")
    shards, blocks = SIM._tiles(rows.select("qid", "vec"), prep)
    assert prep.n_shards == 1 and shards == blocks and shards * blocks >= 4 * spark.sparkContext.defaultParallelism
    got = {r.qid: (r.match_pos, round(r.score, 9)) for r in SIM.nearest(rows, prep, exclude_self=True).collect()}
    assert got == want


def test_shards_and_blocks_have_a_bound():
    assert SIM.TILE_BYTES <= 32 << 20 and PR.SHARD_BYTES <= 16 << 20
    assert 6 * 8 * PR.BOUND_CELLS <= 64 << 20  # arrays of bounds in a task of the pruned search


def test_files_of_a_stream_grow_with_its_rows():
    assert QS.arriving_files(0) == 4 and QS.arriving_files(10 * QS.FILE_ROWS) == 10 and QS.arriving_files(10 * QS.FILE_ROWS + 1) == 11
