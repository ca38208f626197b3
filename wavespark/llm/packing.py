"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of the largest length at most. The longest piece that is left opens a bin. Which
length costs least depends on what can fill it: for every permitted length the bin is filled on paper, always by the piece
at hand that fits best, that is, leaves least room; what it then holds shrinks the bin to the least permitted length, and the
length with the least cost a word wins. The bin takes those pieces, and the next one opens with what is left. So
every choice is made on the bin's real contents, and at the end every bin has the least permitted length that holds its
contents. What is cheapest for one bin may use up short pieces that others need; so all this is done for every set of
lengths to open bins with, and the set with the least cost in all wins. It never costs more than one length alone.

The cost of a sequence is OVERHEAD + n + n * n / QUADRATIC: steps, linear layers and attention.

Equal rows are counted first; copies are dealt in lots of LOT. Lots go to groups of about GROUP documents by a hash of
doc_id, text and lot; a group packs for itself, so no task holds more than its groups, and bins of different groups don't
depend on each other. The loss is at most the last few bins of each group.

Defined results: a null or empty text has no words; it gets one row with piece 0, 0 words and null bin. Repeated
rows are packed one by one. Of lengths with equal cost a word the shorter wins, of pieces of equal length that with the
least doc_id (null last). Extra columns are ignored. An empty table gives an empty table. No text is dropped or
shortened: the pieces of a document add up to it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.llm import storage
from wavespark.llm.mixing import size

LENGTHS = (256, 512, 1024, 2048, 4096)
OVERHEAD, QUADRATIC = 128, 16384
GROUP = 20_000
#: copies of a document that stay together
LOT = 1000


def cost(n: int) -> float:
    return OVERHEAD + n + n * n / QUADRATIC


def fill(sizes: list[int], count: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(size, number) of the pieces that go into ``room`` if each time the one goes in that leaves least of it.
    ``sizes`` ascend; ``count`` says how many of each there are."""
    out = []
    k = bisect_right(sizes, room)
    while k:
        n = sizes[k - 1]
        taken = min(count[n], room // n)
        if taken:
            out.append((n, taken))
            room -= n * taken
        k = bisect_right(sizes, room, 0, k - 1)
    return out


def contents(pieces: list[int], lengths: tuple[int, ...], openings: tuple[int, ...]) -> tuple[float, list[list[tuple[int, int]]], list[int]]:
    """Cost in all, and contents and length of each bin, if bins are opened with the lengths ``openings``, or with the least
    length that holds a piece longer than these."""
    count: dict[int, int] = {}
    for n in pieces:
        count[n] = count.get(n, 0) + 1
    sizes = sorted(count)
    plan: list[list[tuple[int, int]]] = []
    final: list[int] = []
    while sizes:
        least = None
        for x in openings if sizes[-1] <= openings[-1] else (lengths[bisect_left(lengths, sizes[-1])],):
            if x < sizes[-1]:
                continue
            own = fill(sizes, count, x)
            held = sum(n * c for n, c in own)
            length = lengths[bisect_left(lengths, held)]
            if least is None or (cost(length) / held, length) < least[0]:
                least = (cost(length) / held, length), own
        (_, length), own = least
        # as often as the pieces last: bins with the same contents cost the same
        again = min(count[n] // c for n, c in own)
        for n, c in own:
            count[n] -= c * again
            if not count[n]:
                sizes.pop(bisect_left(sizes, n))
        plan += [own] * again
        final += [length] * again
    return sum(map(cost, final)), plan, final


def pack(pieces: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the length of each bin. ``pieces`` come longest first."""
    lengths = tuple(sorted(lengths))
    sets = [x for k in range(len(lengths), 0, -1) for x in combinations(lengths, k)]
    _, plan, final = min((contents(pieces, lengths, x) for x in sets), key=lambda x: x[0])  # the first of equals: the larger set
    places: dict[int, list[tuple[int, int]]] = {}  # of each size, where its pieces go
    for b, own in enumerate(plan):
        at = 0
        for n, c in own:
            places.setdefault(n, []).extend((b, at + k * n) for k in range(c))
            at += n * c
    turn = {n: iter(x) for n, x in places.items()}
    where = [next(turn[n]) for n in pieces]
    return [b for b, _ in where], [at for _, at in where], final


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """doc_id, piece, first, n_words, bin, seq_len, seq_offset: a row for each piece of each document."""
    kind, most = docs.schema["doc_id"].dataType.simpleString(), max(lengths)
    sizes = docs.select("doc_id", size().alias("n"), F.xxhash64("doc_id", "text").alias("h")).groupBy("doc_id", "h", "n").agg(F.count("*").alias("copies"))
    sizes = storage.table(sizes, "sizes")
    total = sizes.agg(F.sum("copies")).first()[0] or 0
    groups = max(1, -(-total // GROUP))
    lots = sizes.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LOT))))
    lots = lots.withColumn("times", F.least(F.col("copies") - F.col("lot") * LOT, F.lit(LOT))).select("doc_id", "h", "n", "times", F.pmod(F.xxhash64("h", "lot"), F.lit(groups)).alias("g"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.loc[rows.index.repeat(rows.times)]
        pieces = (-(-rows.n // most)).clip(lower=1)
        rows = rows.loc[:, ["doc_id", "h", "n"]].reset_index(drop=True).loc[np.repeat(np.arange(len(rows)), pieces)].reset_index(drop=True)
        rows["piece"] = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces).to_numpy()
        rows["first"] = rows.piece * most
        rows["n_words"] = (rows.n - rows["first"]).clip(upper=most)
        rows = rows.sort_values(["n_words", "doc_id", "h", "piece"], ascending=[False, True, True, True], kind="stable")
        some = rows[rows.n_words > 0]
        bins, offsets, final = pack(some.n_words.tolist(), lengths)
        base = int(key[0]) << 32
        out = rows[["doc_id", "piece", "first", "n_words"]].copy()
        empty = [None] * (len(rows) - len(some))
        out["bin"] = pd.array([base + b for b in bins] + empty, dtype="Int64")
        out["seq_len"] = pd.array([final[b] for b in bins] + empty, dtype="Int32")
        out["seq_offset"] = pd.array(offsets + empty, dtype="Int32")
        return out

    return lots.groupBy("g").applyInPandas(run, f"doc_id {kind}, piece int, first long, n_words long, bin long, seq_len int, seq_offset int")
