"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of BLOCK words each. Slot k looks up its point, frac((k + 1) / phi) by default, in the
cumulative shares of the sources' targets, counted in blocks; so every stretch of slots, however short, holds each
source about in proportion, to the end: the schedule is made long enough for every source to find its slots in it.
A source's documents are put in a random but repeatable order and read round and round as one stream of words,
cut into blocks of equal length; the source's r-th slot takes its r-th block. A source's last block is cut where its
target is reached. So the words taken from a source are its target, rounded, and their order is that of the slots.

Positions in a stream are prefix sums by (source, hash bucket) plus an offset for each bucket; slot ranks are
counted by chunks of slots. No window holds a whole source or the whole schedule, and buckets grow in number with the
rows.

Defined results: a null text has size 0 and nothing is taken from it; a null source is a source of its own, last.
A stream's order is that of hashes of doc_id and text: null and equal doc_ids don't matter. Equal rows stand side by side
and count one by one. Extra columns are ignored, or carried by ``repeat``. An empty table gives an empty table;
if all sizes are 0 all targets are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavespark.llm import storage
from wavespark.llm.words import WORD

GOLDEN = (math.sqrt(5) - 1) / 2
MOST_REPEATS = 3
#: words in a block
BLOCK = 1024
#: rows of a source in a bucket, about
BUCKET = 20_000
_CHUNK = 4096


def golden(k: np.ndarray) -> np.ndarray:
    x = (k + 1) * GOLDEN
    return x - np.floor(x)


def van_der_corput(k: np.ndarray) -> np.ndarray:
    """Bits of k + 1 mirrored at the binary point."""
    left, out, unit = k.astype(np.int64) + 1, np.zeros(len(k)), 0.5
    while left.any():
        out += unit * (left & 1)
        left >>= 1
        unit /= 2
    return out


def order_key(seed: str):
    """Random but repeatable order of rows by doc_id and text."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))))


def size():
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")


def cyclic_weights(sources: list[str | None]) -> dict[str | None, int]:
    """1, 2, 3, repeating, by code point, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: k % 3 + 1 for k, s in enumerate(order)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Share the sum of all sizes by weight; what exceeds ``most`` times a source's size goes to the others."""
    open_, out = dict(weights), {}
    left = sum(sizes.values())
    while open_:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / total > most * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in open_.items()}
        # the tightest first: filling up the others may only raise what is left for each
        s = min(over, key=lambda s: (most * sizes[s] / open_[s], s is None, s or ""))
        out[s] = float(most * sizes[s])
        left -= most * sizes[s]
        del open_[s]
    return out


class Mix:
    """The plan for one table: sources are few (weights are given by source), so they are known to the driver."""

    def __init__(self, docs: DataFrame, weights=cyclic_weights, seed: str = "mix", points=golden):
        self.spark, self.seed, self.points, self.block = docs.sparkSession, seed, points, BLOCK
        rows = storage.table(docs.select("doc_id", "source", size().alias("size"), order_key(seed).alias("h")), "sizes")
        found = {r["source"]: (r["n"], r["rows"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()}
        self.order = sorted(found, key=lambda s: (s is None, s or ""))
        self.sizes = {s: n for s, (n, _) in found.items()}
        most = max((n for _, n in found.values()), default=0)
        self.digits = max(3, math.ceil(math.log(max(most / BUCKET, 1), 16)) + 1)
        self.targets = targets(self.sizes, weights(list(found)))
        self.total = sum(self.sizes.values())
        self.take = {s: math.floor(self.targets[s] + 0.5) for s in self.order}
        made = [(k, s, int(self.sizes[s]), float(self.targets[s]), int(self.take[s])) for k, s in enumerate(self.order)]
        self.sources = self.spark.createDataFrame(made, "source_no int, of string, source_size long, target double, take long")
        self.placed = storage.table(self._place(rows), "placed")

    def _place(self, rows: DataFrame) -> DataFrame:
        """Add source_no, source_size, target, take, bucket, start (the place of each row in its source's stream) and
        twin, the row's number among its equals."""
        rows = self.number(rows).withColumn("bucket", F.substring("h", 1, self.digits))
        sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("__n"))
        before = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        offsets = sums.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
        own = W.partitionBy("source_no", "bucket").orderBy("h")
        rows = rows.withColumn("__end", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("twin", F.row_number().over(own) - F.rank().over(own))
        return rows.join(offsets, ["source_no", "bucket"]).withColumn("start", F.col("__base") + F.col("__end") - F.col("size")).drop("__end", "__base")

    def number(self, rows: DataFrame) -> DataFrame:
        """Join what is known of the rows' sources."""
        return rows.join(self.sources, rows["source"].eqNullSafe(self.sources["of"])).drop("of")

    def schedule(self) -> DataFrame:
        """slot, source_no, rank: each source has exactly the slots that its target needs, its first ones."""
        need = np.array([-(-self.take[s] // self.block) for s in self.order], np.int64)
        total, points = int(need.sum()), self.points
        self.slots = 0
        if not total:
            return self.spark.createDataFrame([], "slot long, source_no int, rank long")
        bounds = np.cumsum(need) / total

        def run(batches):
            for b in batches:
                k = b.column(0).to_numpy()
                no = np.searchsorted(bounds, points(k), "right")
                yield pa.RecordBatch.from_pydict({"slot": b.column(0), "source_no": pa.array(no, pa.int32()), "chunk": pa.array(k // _CHUNK, pa.int64())})

        n = total + total // 50 + 16
        while True:
            drawn = self.spark.range(0, n).mapInArrow(run, "slot long, source_no int, chunk long")
            counts = storage.table(drawn.groupBy("source_no", "chunk").count(), "counts")
            got = {r["source_no"]: r["n"] for r in counts.groupBy("source_no").agg(F.sum("count").alias("n")).collect()}
            if all(got.get(k, 0) >= x for k, x in enumerate(need)):
                break
            n += n // 4 + 16  # low discrepancy: a few rounds at most
        self.slots = n
        before = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        offsets = counts.withColumn("__base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        own = W.partitionBy("source_no", "chunk").orderBy("slot")
        ranked = drawn.withColumn("__r", F.row_number().over(own) - 1).join(offsets, ["source_no", "chunk"]).select("slot", "source_no", (F.col("__r") + F.col("__base")).alias("rank"))
        wanted = self.spark.createDataFrame([(k, int(x)) for k, x in enumerate(need)], "source_no int, need long")
        return ranked.join(wanted, "source_no").filter("rank < need").select("slot", "source_no", "rank")

    def plan(self) -> DataFrame:
        """slot, source_no, bucket, start (both of the document), first, words: which words of which document a
        slot holds. A document longer than a block spans several."""
        b = F.lit(self.block)
        passes = self.placed.select("source_no", "bucket", "start", "size", "source_size", "take").filter("size > 0 and take > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))))
        lo = F.col("pass") * F.col("source_size") + F.col("start")
        spans = passes.withColumn("lo", lo).filter("lo < take").withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take")))
        pieces = spans.withColumn("rank", F.explode(F.sequence((F.col("lo") / b).cast("long"), ((F.col("hi") - 1) / b).cast("long"))))
        begin, end = F.greatest(F.col("lo"), F.col("rank") * b), F.least(F.col("hi"), (F.col("rank") + 1) * b)
        pieces = pieces.select("source_no", "rank", "bucket", "start", (begin - F.col("lo")).alias("first"), (end - begin).alias("words"))
        return self.schedule().join(pieces, ["source_no", "rank"]).select("slot", "source_no", "bucket", "start", "first", "words")


def taken(docs: DataFrame, weights=cyclic_weights, points=golden) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the document's place in the mix: first_slot (null if it has none)
    and n_pieces, of slots that it has words in. A row for each row of ``docs``."""
    mix = Mix(docs, weights, points=points)
    key = ["source_no", "bucket", "start"]
    sums = mix.plan().groupBy(*key).agg(F.sum("words").alias("__t"), F.min("slot").alias("first_slot"), F.count("*").alias("__p"))
    some = mix.placed.filter("size > 0").join(sums, key, "left")
    none = mix.placed.filter("size = 0")
    return some.unionByName(none, allowMissingColumns=True).select("doc_id", "size", "source_size", "target", F.coalesce("__t", F.lit(0)).alias("taken"), "first_slot", F.coalesce("__p", F.lit(0)).alias("n_pieces"))


def repeat(docs: DataFrame, weights=cyclic_weights, points=golden) -> DataFrame:
    """The rows of ``docs`` as often as the mix reaches their first word, whole and with all their columns, in order
    of the slots that hold it: a partition has a stretch of slots.

    Only narrow rows are placed; whole ones meet them by hash. Equal rows are told apart by number, only if there are any."""
    mix = Mix(docs, weights, points=points)
    key = ["source_no", "bucket", "start"]
    copies = mix.plan().filter("first = 0").groupBy(*key).agg(F.collect_list("slot").alias("__slots"))  # MOST_REPEATS at most
    picked = mix.placed.filter("size > 0").join(copies, key).select("source_no", "h", "twin", "__slots")
    parts = max(1, min(int(mix.spark.conf.get("spark.sql.shuffle.partitions")), mix.slots))
    text = F.col("__row.text")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).select("__row", F.col("__row.doc_id").alias("doc_id"), F.col("__row.source").alias("source"), text.alias("text"))
    whole = mix.number(whole.select("__row", "source", order_key(mix.seed).alias("h"))).select("__row", "source_no", "h")
    if mix.placed.filter("twin > 0").isEmpty():
        rows = whole.join(picked, ["source_no", "h"])
    else:
        twins = W.partitionBy("source_no", "h").orderBy(F.xxhash64("__row"))
        rows = whole.withColumn("twin", F.row_number().over(twins) - 1).join(picked, ["source_no", "h", "twin"])
    rows = rows.withColumn("__slot", F.explode("__slots")).select("__row", "__slot", "h")
    return rows.repartitionById(parts, (F.col("__slot") * parts / max(mix.slots, 1)).cast("int")).sortWithinPartitions("__slot", "h").select("__row.*")


TAKEN_SQL = r"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
      FROM s WINDOW o AS (ORDER BY 18 * source_size // w, source NULLS LAST)),
c AS (SELECT *, bool_and(rest * w > 3 * source_size * ws) OVER (ORDER BY 18 * source_size // w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS capped FROM f),
g AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
        ELSE CAST((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)) * w AS DOUBLE) / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM c),
l AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS l, (CAST(floor(target + 0.5) AS BIGINT) + 1023) // 1024 AS need FROM g),
b AS (SELECT source, need, sum(need) OVER () AS total, CAST(sum(need) OVER (o ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS hi, CAST(sum(need) OVER (o ROWS UNBOUNDED PRECEDING) - need AS DOUBLE) AS lo
      FROM l WINDOW o AS (ORDER BY source NULLS LAST)),
x AS (SELECT k AS slot, (k + 1) * 0.6180339887498949 - floor((k + 1) * 0.6180339887498949) AS x FROM (SELECT unnest(range(CAST(3 * sum(need) + 64 AS BIGINT))) AS k FROM l)),
k AS (SELECT b.source, x.slot, row_number() OVER (PARTITION BY b.source ORDER BY x.slot) - 1 AS rank FROM x JOIN b ON x.x >= b.lo / CAST(b.total AS DOUBLE) AND x.x < b.hi / CAST(b.total AS DOUBLE)),
p AS (SELECT d.*, source_size, target, l, sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', 'mix', d.doc_id, md5(d.text))), d.doc_id ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
n AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (l // source_size) * size + greatest(0, least(size, l % source_size - start)) END AS BIGINT) AS taken FROM p)
SELECT n.doc_id, n.size, n.source_size, n.target, n.taken, k.slot AS first_slot,
  CAST(CASE WHEN n.size = 0 THEN 0 ELSE list_sum([CASE WHEN i * n.source_size + n.start < n.l THEN (least(i * n.source_size + n.start + n.size, n.l) - 1) // 1024 - (i * n.source_size + n.start) // 1024 + 1 ELSE 0 END
    for i in [0, 1, 2]]) END AS BIGINT) AS n_pieces
FROM n LEFT JOIN k ON n.taken > 0 AND k.source IS NOT DISTINCT FROM n.source AND k.rank = n.start // 1024
"""
