"""Counting quotient filters: nothing is lost, merges add up, lookups find every count."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiflow.llm import cqf


def made(rng, n, m, width, spread):
    rows = rng.integers(0, min(spread, 1 << width), (n, m))
    return [tuple(r) for r in rows.tolist()], [rows[:, i] for i in range(m)]


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 5), st.integers(1, 25), st.integers(0, 400), st.sampled_from([2, 5, 1 << 24]), st.integers(0, 3), st.integers(0, 99))
def test_round_trip_and_counts(m, width, n, spread, prefix, seed):
    rng = np.random.default_rng(seed)
    rows, cols = made(rng, n, m, width, spread)
    bits = m * width
    prefix = min(prefix, bits, 64)
    hi, lo = cqf.pack(cols, width)
    assert [tuple(x) for x in np.array(cqf.unpack(hi, lo, m, width)).T.tolist()] == rows
    top, low = cqf.permute(hi, lo, bits)
    back = cqf.restore(top, low, bits)
    assert np.array_equal(back[0], hi) and np.array_equal(back[1], lo)
    want, got = Counter(rows), Counter()
    for value, f in cqf.by_prefix(bits, prefix, *cqf.counted(top, low)):
        f = cqf.Filter.from_bytes(f.to_bytes())
        t, s, c = f.entries()
        assert f.head == value
        k = np.array(cqf.unpack(*cqf.restore(t, s, bits), m, width)).T.tolist()
        got.update({tuple(x): int(y) for x, y in zip(k, c, strict=True)})
        found = f.counts(top, low)
        assert all(x in (0, want[r]) for x, r in zip(found.tolist(), rows, strict=True))
        assert np.array_equal(f.counts(t, s), c)
    assert got == want


def test_merge_adds_and_absent_keys_count_zero():
    rng = np.random.default_rng(1)
    total, parts = Counter(), []
    for _ in range(5):
        rows, cols = made(rng, 3000, 5, 20, 6)
        total.update(rows)
        parts.append(cqf.Filter(100, 0, *cqf.counted(*cqf.permute(*cqf.pack(cols, 20), 100))))
    f = cqf.merge(parts)
    t, s, c = f.entries()
    keys = np.array(cqf.unpack(*cqf.restore(t, s, 100), 5, 20)).T.tolist()
    assert {tuple(k): n for k, n in zip(keys, c.tolist(), strict=True)} == dict(total)
    absent = cqf.permute(*cqf.pack([np.full(50, 7) + np.arange(50)] * 5, 20), 100)
    assert not f.counts(*absent).any()
    assert len(f.to_bytes()) < 100 / 8 * f.size  # less, with the counts, than the bare keys


def test_large_counts_and_wide_keys_are_refused():
    f = cqf.Filter(10, 0, np.array([3, 900], np.uint64), np.zeros(2, np.uint64), np.array([1 << 60, 2]))
    assert cqf.Filter.from_bytes(f.to_bytes()).n.tolist() == [1 << 60, 2]
    with pytest.raises(ValueError):
        cqf.permute(np.zeros(1, np.uint64), np.zeros(1, np.uint64), 130)
