"""Sorts of ids and hashes by the quickest way give the order of the plain way."""

import numpy as np
import pytest

from wavespark.llm import lm


@pytest.mark.parametrize("most", [1, 50, 1 << 20, 1 << 40, 1 << 63])
def test_sorts(most):
    r = np.random.default_rng(most % 97)
    columns = [r.integers(0, most, 5000, dtype=np.uint64) for _ in range(3)]
    plain, own = np.lexsort(columns[::-1]), lm._in_order(columns)
    assert all((c[plain] == c[own]).all() for c in columns)
    keys, inverse, n = np.unique(columns[0], return_inverse=True, return_counts=True)
    at, place, count = lm._distinct(columns[0])
    assert (columns[0][at] == keys).all() and (place == inverse).all() and (count == n).all()
    shard = r.integers(0, 1 << 18, 5000)
    for s in (shard, shard % 64, shard[:0]):
        assert (lm._by_shard(s) == np.argsort(s, kind="stable")).all()
    assert [len(x) for x in lm._distinct(columns[0][:0])] == [0, 0, 0]
