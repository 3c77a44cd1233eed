"""JN-4 prefix filtering: every match at or above the threshold, few comparisons."""

import random

import numpy as np
import pytest

from lexiflow.operators import memory as MEM
from lexiflow.operators import threshold as TH


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    rare = [f"rare{i}" for i in range(400)]
    common = ["the", "and", "for", "with", "that"]
    out = []
    for _ in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(8))] + rng.sample(rare, rng.randrange(1, 9))
        out.append(" ".join(words))
    for k in range(40):  # near copies
        words = out[k].split()
        words[rng.randrange(len(words))] = rng.choice(rare)
        out.append(" ".join(words))
    return out


def entries(spark, texts):
    rows = [(i, t, f"s{i}", i, "a" if i % 2 else None if i % 5 == 0 else "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "mem_id long, text string, standard string, pos long, label string").repartition(3)


@pytest.mark.parametrize("threshold,same_label,group_rows", [(0.75, False, 20_000), (0.7, True, 30), (0.5, False, 12)])
def test_equals_the_full_search(spark, monkeypatch, threshold, same_label, group_rows):
    """Also with groups so small that frequent terms and copies are cut into shards and blocks."""
    monkeypatch.setattr(TH, "GROUP_ROWS", group_rows)
    if same_label:
        monkeypatch.setattr(TH, "BROADCAST_TERMS", 3)
    texts = corpus()
    mem_rows = [*texts[:120], *[texts[3]] * 50, "the and for", "the the and"]
    q_texts = [*texts[100:], *[texts[3]] * 60, "the and for", "and for the with", "nothing known", "", None]
    mem = MEM.TextMemory(entries(spark, mem_rows), with_label=same_label, force="broadcast")
    rows = [(i % 90, t, ("a", "b", None)[i % 3]) for i, t in enumerate(q_texts)]
    q = spark.createDataFrame(rows, "id long, text string, label string").repartition(4)
    label = "label" if same_label else None
    want = sorted((r.id, r.text or "", str(r.label), *((r.mem_id, r.mem_standard, round(r.mem_score, 9)) if r.mem_score and r.mem_score >= threshold else (-1, "", 0))) for r in mem.match(q, "id", "text", label).collect())
    out = mem.match_above(q, threshold, "id", "text", label).collect()
    got = sorted((r.id, r.text or "", str(r.label), *((r.mem_id, r.mem_standard, round(r.mem_score, 9)) if r.mem_score else (-1, "", 0))) for r in out)
    assert got == want and sum(r[3] >= 0 for r in got) > 20
    if threshold == 0.75:
        compared = sum(r.mem_compared for r in out)
        assert 0 < compared < len(q_texts) * len(mem_rows) / 20


def test_prefix_holds_the_first_common_term():
    """On random vectors: a pair that reaches the threshold shares a prefix term."""
    rng = np.random.default_rng(5)

    def prefix(w, t):
        rest = np.sqrt(np.cumsum((w * w)[::-1])[::-1])
        p = 1
        while p < len(w) and rest[p] >= t:
            p += 1
        return p

    hits = 0
    for _ in range(400):
        base = np.sort(rng.choice(60, rng.integers(2, 12), replace=False))
        other = np.unique(np.concatenate([rng.permutation(base)[: rng.integers(1, len(base) + 1)], rng.choice(60, 2)]))
        a, b = rng.random(len(base)) + 0.01, rng.random(len(other)) + 0.01
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        dot = sum(a[i] * b[list(other).index(t)] for i, t in enumerate(base) if t in other)
        if dot >= 0.7:
            hits += 1
            assert set(base[: prefix(a, 0.7)]) & set(other[: prefix(b, 0.7)])
    assert hits > 30


def test_empty_sides_and_bad_threshold(spark):
    mem = spark.createDataFrame([(0, ["a"], [1.0])], "pos long, terms array<string>, ws array<double>")
    q = spark.createDataFrame([("x", ["a", "z"], [2.0, 0.1]), ("y", [], [])], "qid string, terms array<string>, ws array<double>")
    got = {r.qid: (r.match_pos, r.compared) for r in TH.nearest_above(q, mem, 0.9).collect()}
    assert got == {"x": (0, 1), "y": (None, 0)}
    assert TH.nearest_above(q, mem.where("pos > 9"), 0.9).where("match_pos is not null").count() == 0
    assert TH.nearest_above(q.where("qid = 'n'"), mem, 0.9).count() == 0
    with pytest.raises(ValueError):
        TH.nearest_above(q, mem, 0.0)
