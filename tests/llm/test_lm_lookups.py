"""Scoring looks every window of words up once, and goes through each table from one end to the other."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wavespark.llm import lm


def test_each_window_once_in_order(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 8, 500)) for _ in range(6)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    model = lm.train(docs)
    asked, find_all, find = Counter(), lm.Tables.find, lm.Table.find

    def counted(self, keys, *rest):
        asked[self.at.rpartition("/")[2]] += len(keys)
        return find_all(self, keys, *rest)

    def ordered(self, keys):
        assert (np.diff(self.bucket(keys, self.bits)) >= 0).all()
        return find(self, keys)

    monkeypatch.setattr(lm.Tables, "find", counted)
    monkeypatch.setattr(lm.Table, "find", ordered)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)  # runs here, where look-ups are counted
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(6)], "held_out": [False] * 6, "text": texts})
    assert sum(b.num_rows for b in lm.score(docs, model)([batch])) == 6
    words, begin = 9, 2  # with the end token; windows that hold begin symbols only, or those and the text before
    assert max(asked["g1"], asked["c2"]) <= words + 1
    assert max(asked["g2"], asked["c3"]) <= words**2 + words + begin
    assert asked["g3"] <= words**3 + words**2 + 2 * words


@pytest.mark.parametrize("most", [0, 1, 255, 256, (1 << 32) - 1, 1 << 32, (1 << 64) - 1])
def test_planes(most):
    for a in (np.array([most, 0, most // 3], np.uint64), np.array([most], np.uint64), np.empty(0, np.uint64)):
        back = lm._from_planes(lm._planes(a))
        assert back.dtype == np.uint64 and (back == a).all() and len(back) == len(a)


def test_order_where_many_rows_share_their_first_64_bits():
    r = np.random.default_rng(4)
    columns = [r.integers(0, 3, 4000).astype(np.uint64) << np.uint64(20) for _ in range(3)] + [r.integers(0, 1 << 20, 4000).astype(np.uint64)]
    rows = [*zip(*(c[lm._in_order(columns)].tolist() for c in columns), strict=True)]
    assert rows == sorted(zip(*(c.tolist() for c in columns), strict=True))


def test_workers_keep_the_arrays_of_one_model(spark, monkeypatch):
    """A long-lived worker doesn't map the arrays of all models that it ever scored with."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").coalesce(1)
    models = [lm.train(docs, 2) for _ in range(3)]
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "held_out": [False], "text": ["a b c"]})
    for m in [*models, models[0], models[0]]:
        assert [b.num_rows for b in lm.score(docs, m)([batch])] == [1]
        assert [*lm._cache] == [m.folder]
