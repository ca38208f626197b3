import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wavespark.llm import near, words


def shingles(text):
    w = re.findall(words.WORD, text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """class_id and n_links of each (doc_id, text) by comparing all."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = defaultdict(int)
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets):
            if i != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (d, _) in enumerate(sets):
        r = find(k)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[find(k)], links[k]) for k, (d, _) in enumerate(sets)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def copies(seed, n=12):
    """Texts with exact copies, near copies at all distances, and passages that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(60)]
    rows, doc = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(3, 150))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = shared
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 12])):
                own[rng.randrange(len(own))] = word()
            rows.append((doc, " ".join(own)))
            doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, monkeypatch, seed):
    if seed == 3:
        monkeypatch.setattr(near, "BLOCK_ROWS", 2)  # blocks of a group meet in pairs
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(near.join(docs)) == plain(rows)
    stay = [r["doc_id"] for r in near.one_of_each(docs).collect()]
    assert sorted(stay) == sorted({c for _, c, _ in plain(rows)})


def test_chains_join_one_class(spark):
    """Each text is close to the next only, so the class is a path: no star sees all of it."""
    w = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(30):
        own = [*w[3 * k :], *(f"x{j}" for j in range(3 * k))][:100]
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near.join(docs)) == plain(rows)


def test_large_group(spark, monkeypatch):
    """A third of the rows are copies of one text, another third near copies."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 16)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base)) for k in range(100)]
    for k in range(100, 200):
        own = list(base)
        own[rng.randrange(120)] = f"y{k}"
        rows.append((k, " ".join(own)))
    rows += [(k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(50))) for k in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(near.join(docs)) == plain(rows)


def test_band_choice():
    bands, rows = near.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert near.choose_bands(0.8, 0.9999, 400)[1] > rows
    with pytest.raises(ValueError):
        near.choose_bands(0.1, 0.999999, 4)


def test_recall_of_bands():
    """The measured share of pairs that meet in a bucket follows 1 - (1 - s ** rows) ** bands."""
    rng = np.random.default_rng(4)
    bands, rows, meet, n, expected = 4, 3, 0, 300, 0.0
    for _ in range(n):
        common, own = rng.integers(0, 1 << 62, 60), rng.integers(0, 1 << 62, (2, 20))
        a, b = (np.unique(np.concatenate([common, x]).astype(np.uint64)) for x in own)
        keys = near._bands(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), bands, rows)
        meet += bool((keys[0] == keys[1]).any())
        expected += 1 - (1 - (60 / 100) ** rows) ** bands
    assert abs(meet - expected) < 4 * math.sqrt(expected * (1 - expected / n))


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100 + k, 100) for k in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    found = dict(map(tuple, near.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {v: r for v, r in found.items() if v <= 50} == dict.fromkeys(range(51), 0)
    assert {found[100 + k] for k in range(30)} == {100} and found[301] == 300 and 200 not in found
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(near.join(awkward)) == plain(rows)
    stay = near.one_of_each(awkward)
    assert stay.columns == awkward.columns
    assert sorted((r["doc_id"] for r in stay.collect()), key=repr) == sorted([1, 3, 4, 5, 7, 8, 9, None, None], key=repr)
    assert near.join(nothing).count() == 0 and near.one_of_each(nothing).count() == 0


def test_dissimilar_texts_of_one_id(spark):
    """One row of each class stays, also where classes have no doc_id or the same."""
    text = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (None, text("e")), (None, text("e") + " tail"), (None, text("f")), (2, text("f") + " tail"), (None, text("a"))]
    stay = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in stay) == [(0, "a"), (0, "b"), (0, "e"), (1, "c"), (1, "d"), (2, "f")]


def test_shingles_of_short_texts():
    (c,) = words.chunks(pa.array(["a b c", "a b c", "a b", "c a b", "", "a b c d e", "a b c d e a b c d e"]))
    row, w = near.shingles(c)
    assert np.bincount(row, minlength=7).tolist() == [1, 1, 1, 1, 0, 1, 5] and w[0] == w[1] and len(set(w[1:4])) == 3
