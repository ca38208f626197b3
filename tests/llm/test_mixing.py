import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wavespark.llm import mixing, words


def plain(rows, weights=mixing.cyclic_weights, block=1024, point=lambda k: (k + 1) * mixing.GOLDEN % 1):
    """taken, first_slot and n_pieces of each (doc_id, source, text): walk each source's stream word by word, and the
    schedule slot by slot."""
    size = lambda t: len(re.findall(words.WORD, t or ""))
    streams = defaultdict(list)
    for k, (d, s, t) in enumerate(rows):
        key = ":".join(x for x in ("mix", None if d is None else str(d), None if t is None else hashlib.md5(t.encode()).hexdigest()) if x is not None)
        streams[s].append((hashlib.md5(key.encode()).hexdigest(), -1 if d is None else d, size(t), k))
    sizes = {s: sum(x[2] for x in own) for s, own in streams.items()}
    goal = mixing.targets(sizes, weights(list(sizes)))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    need = [-(-math.floor(goal[s] + 0.5) // block) for s in order]
    slots, k = {s: [] for s in order}, 0
    while any(len(slots[s]) < n for s, n in zip(order, need, strict=True)):
        below = 0
        for s, n in zip(order, need, strict=True):
            below += n
            if point(k) < below / sum(need):
                if len(slots[s]) < n:
                    slots[s].append(k)
                break
        k += 1
    taken, where, pieces = [0] * len(rows), [set() for _ in rows], [set() for _ in rows]
    for s, own in streams.items():
        order = [k for *_, n, k in sorted(own) for _ in range(n)]
        for j in range(math.floor(goal[s] + 0.5)):
            k = order[j % len(order)]
            taken[k] += 1
            where[k].add(slots[s][j // block])
            pieces[k].add((j // len(order), j // block))
    out = [(d, size(t), sizes[s], goal[s], taken[k], min(where[k], default=None), len(pieces[k])) for k, (d, s, t) in enumerate(rows)]
    return sorted(out, key=repr), goal, sizes


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 1024])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(k, f"s{k % 7 * (k % 3)}" if k % 11 else None, "w " * (k * 37 % 90)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    want, goal, sizes = plain(rows, block=block)
    assert rows_of(mixing.taken(docs)) == want == rows_of(mixing.taken(docs.repartition(5)))
    assert math.isclose(sum(goal.values()), sum(sizes.values())) and all(goal[s] <= 3 * n for s, n in sizes.items())
    assert all(t <= 3 * n for _, n, _, _, t, *_ in want)


@pytest.mark.parametrize("name", ["van_der_corput", "none"])
def test_points_decide(spark, monkeypatch, name):
    """Another sequence of points gives other slots, and those that a plain walk gives."""
    monkeypatch.setattr(mixing, "BLOCK", 9)
    rows = [(k, f"s{k % 3}", "w " * (k * 37 % 90)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mirrored = lambda k: int(f"{k + 1:b}"[::-1], 2) / (1 << (k + 1).bit_length())
    points, point = {"van_der_corput": (mixing.van_der_corput, mirrored), "none": (lambda k: (k * 0.37 + 0.1) % 1, lambda k: (k * 0.37 + 0.1) % 1)}[name]
    found = rows_of(mixing.taken(docs, points=points))
    assert found == plain(rows, block=9, point=point)[0] != rows_of(mixing.taken(docs))


def test_targets():
    assert mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 2, "b": 1, "c": 1}) == {"a": 30.0, "b": 90.0, "c": 90.0}
    assert mixing.targets({"a": 0, "b": 0}, {"a": 1, "b": 1}) == {"a": 0, "b": 0}
    # what the first takes no more makes the second full, too
    assert mixing.targets({"a": 10, "b": 20, "c": 1000}, {"a": 6, "b": 3, "c": 1}) == {"a": 30.0, "b": 60.0, "c": 940.0}
    assert mixing.cyclic_weights(["b", None, "a", "c"]) == {"a": 1, "b": 2, "c": 3, None: 1}


def test_schedule_is_even(spark):
    """Every stretch of slots holds each source about in proportion, and each source has its ranks once."""
    rows = [(k, f"s{k % 4}", "w " * 100) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.Mix(docs)
    mix.block = 10
    slots = sorted(tuple(r) for r in mix.schedule().collect())
    need = [-(-mix.take[s] // 10) for s in mix.order]
    goal = [n / sum(need) for n in need]
    for no, share in enumerate(goal):
        ranks = [r for _, s, r in slots if s == no]
        assert sorted(ranks) == list(range(-(-mix.take[mix.order[no]] // 10))) and ranks == sorted(ranks)
        own = {k for k, s, _ in slots if s == no}
        for lo in range(0, max(own) - 100, 50):
            assert abs(len(own & set(range(lo, lo + 100))) - 100 * share) <= 3
    # no tail: the schedule ends, but for a few slots, where the targets are reached
    assert len({k for k, *_ in slots}) == len(slots) and slots[-1][0] <= 1.05 * len(slots)


def test_ranks_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_CHUNK", 16)
    monkeypatch.setattr(mixing, "BLOCK", 5)
    rows = [(k, f"s{k % 3}", "w " * 40) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    monkeypatch.setattr(mixing, "BUCKET", 2)
    assert rows_of(mixing.taken(docs)) == plain(rows, block=5)[0]


def test_awkward(awkward, nothing):
    found = mixing.taken(awkward).collect()
    assert len(found) == awkward.count() and all(r["taken"] <= 3 * r["size"] for r in found)
    assert sum(r["taken"] for r in found) == pytest.approx(sum(r["size"] for r in found), abs=4)
    again = mixing.repeat(awkward)
    assert again.columns == awkward.columns and {r["doc_id"] for r in again.collect()} <= {r["doc_id"] for r in found}
    assert mixing.taken(nothing).count() == 0 and mixing.repeat(nothing).count() == 0


def test_repeat_in_order_of_slots(spark, monkeypatch):
    """Whole rows come in slot order, equal rows and null ids included, as often as a plain walk reaches their start."""
    monkeypatch.setattr(mixing, "BLOCK", 20)
    rows = [(None if k % 5 == 0 else k // 2, f"s{k % 3}", f"w{k // 6} " * (k % 9 * 5), k) for k in range(120)] + [(7, "s1", "same " * 30, 7)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra long").repartition(3)
    found = mixing.repeat(docs)
    kept = found.withColumn("part", F.spark_partition_id()).collect()
    assert found.columns == docs.columns and {r[:4] for r in kept} <= set(rows)
    first = {}
    for r in mixing.taken(docs).collect():
        first.setdefault((r["doc_id"], r["size"]), []).append((r["first_slot"], r["taken"], r["size"]))
    n = Counter((r["doc_id"], len(r["text"].split())) for r in kept)
    assert n == Counter({k: c for k, v in first.items() if (c := sum(-(-t // s) if s else 0 for _, t, s in v))})
    order = [min(s for s, *_ in first[r["doc_id"], len(r["text"].split())]) for r in kept if n[r["doc_id"], len(r["text"].split())] == 1]
    assert order == sorted(order) and len(order) > 10 and {r[4] for r in kept} == set(range(4))


def test_repeat_takes_whole_rows(spark):
    rows = [(k, "rich" if k < 90 else "rare", "w " * 50) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.repeat(docs, lambda s: {"rich": 1, "rare": 1}).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in found} == {"rare": 30, "rich": 70}
