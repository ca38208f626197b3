import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wavespark.llm import lm, queries, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(words.WORD, (text or "").translate(LOWER)), "</s>"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 == 2


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.counts = {order: Counter()}
        for w in texts:
            padded = ["<s>"] * (order - 1) + w
            self.counts[order].update(tuple(padded[k : k + order]) for k in range(len(w)))
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.ctx = {}, {}
        for k, c in self.counts.items():
            of = Counter(c.values())
            self.d[k] = lm.discounts(*(of[j] for j in (1, 2, 3, 4)))
            self.ctx[k] = defaultdict(lambda: [0, 0, 0, 0])
            for g, n in c.items():
                own = self.ctx[k][g[:-1]]
                own[0] += n
                own[min(n, 3)] += 1
        self.words = Counter(x for w in texts for x in w)

    def p(self, h, w, k=None):
        k = self.order if k is None else k
        if not k:
            return 1 / (len(self.words) + 1)
        less = self.p(h[1:], w, k - 1)
        if h not in self.ctx[k]:
            return less
        total, *ones = self.ctx[k][h]
        n = self.counts[k].get((*h, w), 0)
        return (max(n - ([0] + self.d[k])[min(n, 3)], 0) + sum(a * b for a, b in zip(self.d[k], ones, strict=True)) * less) / total

    def score(self, w):
        padded = ["<s>"] * (self.order - 1) + w
        return sum(math.log10(self.p(tuple(padded[k : k + self.order - 1]), padded[k + self.order - 1])) for k in range(len(w)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_same_as_plain_model(spark, data, order):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 60")
    rows = {r["doc_id"]: tokens(r["text"]) for r in docs.collect()}
    model = Plain([w for d, w in rows.items() if not held_out(d)], order)
    found = lm.score(docs, lm.train(docs.filter(~lm.held_out()), order)).collect()
    n, v = sum(model.words.values()), len(model.words)
    for r in found:
        w = rows[r["doc_id"]]
        assert r["held_out"] == held_out(r["doc_id"]) and r["train_tokens"] == n and r["n_tokens"] == len(w)
        assert r["n_known"] == sum(model.words[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10((model.words[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], model.score(w), rel_tol=1e-7)
    some = rows[next(iter(rows))]
    for h in (tuple(["<s>"] * (order - 1)), tuple(some[: order - 1])):
        assert math.isclose(sum(model.p(h, x) for x in model.words) + model.p(h, "unknown!"), 1, rel_tol=1e-9)


def test_query_scores_trigrams(spark, data, tmp_path, monkeypatch):
    """The registered query, against a plain model of order 3, with more shards of n-grams than shuffle partitions."""
    monkeypatch.setattr(lm, "SHARD", 200)
    spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 40").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    model = Plain([w for d, w in rows.items() if not held_out(d)], 3)
    found = queries.op3_lm_scoring(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert math.isclose(r["score"], model.score(rows[r["doc_id"]]), rel_tol=1e-7)


def test_better_than_unigrams_on_held_out_text(spark):
    rng = np.random.default_rng(0)
    follow = {w: rng.integers(0, 50, 3) for w in range(50)}

    def text():
        w, out = int(rng.integers(50)), []
        for _ in range(120):
            out.append(f"w{w}")
            w = int(rng.choice(follow[w]))
        return " ".join(out)

    docs = spark.createDataFrame([(k, text()) for k in range(200)], "doc_id long, text string")
    rows = lm.score(docs, lm.train(docs.filter(~lm.held_out()))).filter("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > 0.5 * sum(r["base_score"] for r in rows)


def test_blocks():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 64, 50, dtype=np.uint64), rng.integers(0, 9, 50).astype(np.uint64)]
    counts = rng.integers(1, 1000, 50).astype(np.uint64)
    back, n = lm._decode(lm._encode(columns, counts))
    assert sorted(zip(*columns, counts, strict=True)) == sorted(zip(*back, n, strict=True))


def test_tables():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        values = rng.geometric(0.01, (len(keys), 4)).astype(np.uint64)
        values[: len(keys) // 2] = 1
        table = lm.Table(lm.Table.build(keys, values))
        there, found = table.find(keys)
        assert there.all() and (found == values).all()
        there, found = table.find(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
        assert there.sum() == 0 and not found.any()


def test_awkward(awkward, nothing):
    rows = lm.score(awkward, lm.train(awkward.filter(~lm.held_out()))).collect()
    assert len(rows) == awkward.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert lm.score(nothing, lm.train(nothing)).count() == 0
    untrained = lm.score(awkward, lm.train(nothing)).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)
