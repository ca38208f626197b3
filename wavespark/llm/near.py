"""N-gram Jaccard join by MinHash banding.

A document is its set of shingles (five words in a row; a shorter text with a word is one shingle). The join finds
all documents whose sets have a Jaccard similarity of THRESHOLD or more. Band and row counts follow from the
recall wanted at the threshold: a pair at the threshold is missed with probability 1 - RECALL at most.

1. Documents with equal sets are one variant; everything below is about variants, so copies cost one row each.
2. Variants are shuffled on band hashes. In each bucket all are compared with one of them, the star, on their full
   sets: as many pairs as the bucket has members.
3. Members that aren't similar to their star are compared with the rest of their bucket: in blocks, whose texts meet
   in one task, and only links that connect the bucket come out. So no link within a bucket is lost.
4. Links make classes (connected components, by alternating large and small stars).
5. Links of a class are counted. Jaccard distance is a metric: two variants whose distances from the class's centre
   add up to 1 - THRESHOLD at most are similar, and a histogram of distances counts those. Only variants further
   out (``far``) are compared, again in blocks.

No step emits all pairs of a group, and a tight group of any size costs time in proportion to its rows; the far ones
of a loose group meet all of it, block by block. Blocks bound a task's memory, so nothing has a cap. Copies are
counted by partial aggregation.

Defined results: a null text is an empty text; texts without a word have no shingles and no links, and each is a
class of its own, also where they are equal. Rows of one doc_id are judged by their texts; a null doc_id is never
the id of a class that has another. Extra columns are ignored, or carried by ``one_of_each``. An empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.llm import storage
from wavespark.llm.words import Chunk, chunks, mix, pair

SHINGLE, THRESHOLD = 5, 0.8
RECALL, MOST_HASHES = 0.9999, 128
#: variants, and bytes of their texts, that meet in one task at most, about
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
_U = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: of the counts that reach the recall with ``most`` hashes, those with most rows in a band,
    as these let the fewest dissimilar pairs through."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(threshold**rows, 1 - 1e-12)))) if threshold**rows > 1e-15 else most + 1
        if bands * rows <= most:
            best = bands, rows
    if not best:
        raise ValueError(f"{most} hashes can't reach a recall of {recall} at {threshold}")
    return best


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash), ordered by both."""
    hashes = c.hashes()
    row_of_word = np.repeat(np.arange(c.rows), c.n_words)
    rows, found = [], []
    for k in range(1, SHINGLE + 1):
        pos, w = c.windows(hashes, k)
        row = row_of_word[pos]
        if k < SHINGLE:
            whole = c.n_words[row] == k
            row, w = row[whole], pair(w[whole], _U(k))
        rows.append(row)
        found.append(w)
    row, w = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((w, row))
    row, w = row[order], w[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (w[1:] != w[:-1])
    return row[new], w[new]


def _variant_ids(n_rows: int, row: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row's set, and whether there is one."""
    n = np.bincount(row, minlength=n_rows)
    out = np.zeros(n_rows, _U)
    some = n > 0
    if len(row):
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[some] = pair(np.add.reduceat(mix(w), at), np.bitwise_xor.reduceat(mix(w + _U(1)), at)) + n[some].astype(_U)
    return out, some


def _bands(row: np.ndarray, w: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each row that has shingles: rows x bands."""
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    rng = np.random.Generator(np.random.PCG64(5))
    flips, factors = rng.integers(0, 1 << 64, (2, bands * rows), dtype=_U)
    out = np.empty((len(at), bands), _U)
    for b in range(bands):
        acc = np.full(len(at), b, _U)
        for k in range(b * rows, (b + 1) * rows):
            if len(at):
                acc = pair(acc, np.minimum.reduceat((w ^ flips[k]) * (factors[k] | _U(1)), at))
        out[:, b] = acc
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, vid (null without shingles) and its band hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                row, w = shingles(c)
                vid, some = _variant_ids(c.rows, row, w)
                keys = _bands(row, w, bands, rows).reshape(-1)
                ends = np.cumsum(np.where(some, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), _long(keys))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.rows), pa.array(vid.view(np.int64), pa.int64(), mask=~some), lists], ["doc_id", "vid", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, vid long, bands array<long>")


def _with_vid(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of ``docs`` and, last, ``__vid``."""
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vids, some = [], []
            for c in chunks(b.column(b.num_columns - 1)):
                vid, there = _variant_ids(c.rows, *shingles(c))
                vids.append(vid)
                some.append(there)
            vid, there = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (vids, some))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vid.view(np.int64), pa.int64(), mask=~there.astype(bool))], [*columns, "__vid"])

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("__vid", LongType())]))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """vid and a text for each wanted variant. A task emits a variant once, so a hot one has a row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for c in chunks(b.column(0)):
                vid, some = _variant_ids(c.rows, *shingles(c))
                first = np.zeros(c.rows, bool)
                for k, v in enumerate(vid.tolist()):
                    if some[k] and v not in seen:
                        seen.add(v)
                        first[k] = True
                at = np.flatnonzero(first)
                yield pa.RecordBatch.from_arrays([_long(vid[at]), b.column(0).take(pa.array(at + c.first))], ["vid", "text"])

    return docs.select("text").mapInArrow(run, "vid long, text string").join(wanted, "vid", "left_semi").dropDuplicates(["vid"])


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted shingle hashes of each text."""
    out = []
    for c in chunks(texts):
        row, w = shingles(c)
        out += np.split(w, np.searchsorted(row, np.arange(1, c.rows)))
    return out


def _similar(shared: np.ndarray, a, b, threshold: float) -> np.ndarray:
    return shared >= threshold * (a + b - shared) - 1e-9


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """star, vid, ok and the distance d from both texts; neighbouring rows mostly share their star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, star_set = None, None
        for b in batches:
            ok, d = [], []
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                stars = part.column(0).to_pylist()
                for k, own in enumerate(_sets(part.column(2))):
                    if stars[k] != star:
                        star, star_set = stars[k], _sets(part.column(3).slice(k, 1))[0]
                    n = np.intersect1d(own, star_set, assume_unique=True).size
                    ok.append(bool(_similar(n, len(own), len(star_set), threshold)))
                    d.append(1 - n / (len(own) + len(star_set) - n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), pa.array(d, pa.float64())], ["star", "vid", "ok", "d"])

    return pairs.select("star", "vid", "text", "star_text").mapInArrow(run, "star long, vid long, ok boolean, d double")


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, meet) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left``, the positions of the similar sets among those of ``right`` that ``meet`` picks."""
    if not len(left) or not len(right):
        return
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    flat, at = np.concatenate([ids[j] for j in right]), np.r_[0, np.cumsum(sizes[right])[:-1]]
    mark = np.zeros(int(max(x.max() for x in ids)) + 1, np.int32)
    for i in left:
        mark[ids[i]] = 1
        shared = np.add.reduceat(mark[flat], at)
        mark[ids[i]] = 0
        hit = right[_similar(shared, sizes[i], sizes[right], threshold) & meet(i, right)]
        yield int(i), hit[hit != i]


def _blocks(members: DataFrame) -> DataFrame:
    """Rows (group, vid, far, text, ...) dealt to pairs (p, q) of blocks of their group, so that each far one meets
    all others; ``slot`` is a row's own block. Groups without a far row have no pairs."""

    def blocks(far):
        n, size = F.count_if(far), F.sum(F.when(far, F.length("text")).otherwise(0))
        return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")

    per = members.groupBy("group").agg(blocks(F.col("far")).alias("nf"), blocks(~F.col("far")).alias("nn")).filter("nf > 0")
    rows = members.join(per, "group").withColumn("slot", F.when(F.col("far"), F.pmod(F.xxhash64("vid"), F.col("nf"))).otherwise(F.col("nf") + F.pmod(F.xxhash64("vid"), F.greatest("nn", F.lit(1)))).cast("int"))
    last = F.when(F.col("far"), F.col("nf") + F.col("nn") - 1).otherwise(F.col("nf") - 1)
    return rows.withColumn("o", F.explode(F.sequence(F.lit(0), last))).withColumn("p", F.least("slot", "o")).withColumn("q", F.greatest("slot", "o")).drop("o", "nf", "nn")


def _in_blocks(rows: pd.DataFrame, p: int, q: int):
    rows = rows.sort_values("vid", kind="stable").reset_index(drop=True)
    slot = rows["slot"].to_numpy()
    return rows, _sets(pa.array(rows["text"], pa.large_string())), np.flatnonzero(slot == p), np.flatnonzero(slot == q)


def _spanning(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect the far rows with each other and with the rest of their group. The rest is connected
    already, through its star; d is the distance from it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, p, q = (int(x) for x in key)
        rows, sets, left, right = _in_blocks(rows, p, q)
        vid, far, d = (rows[c].to_numpy() for c in ("vid", "far", "d"))
        near = np.flatnonzero(~far)
        root = [int(near[0]) if not f else k for k, f in enumerate(far)]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, hits in _links(sets, left, right, threshold, lambda i, r: np.abs(d[r] - d[i]) <= 1 - threshold + 1e-9):
            for j in hits.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((vid[i], vid[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _blocks(members).groupBy("group", "p", "q").applyInPandas(run, "a long, b long")


#: steps of the distance in the histogram
_STEPS = 1024


def _degrees(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """vid and the weight of all variants of its group that it links to; d: the distance from the group's centre, null
    where it isn't known."""
    reach = math.floor((1 - threshold) * _STEPS + 1e-9)
    rows = members.withColumn("step", F.ceil(F.col("d") * _STEPS).cast("int"))  # null where d is
    rows = rows.withColumn("far", F.coalesce(2 * F.col("step") > reach, F.lit(True)))
    counts = rows.filter(F.col("step") <= reach).groupBy("group", "step").agg(F.sum("weight").alias("w"))
    table = counts.groupBy("group").agg(F.collect_list(F.struct("step", "w")).alias("table"))  # a row for each step at most
    sure = F.aggregate(F.filter("table", lambda x: x["step"] + F.col("step") <= reach), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    own = F.when(~F.col("far"), F.col("weight")).otherwise(0)
    certain = rows.join(table, "group").select("vid", (F.when(F.col("step") <= reach, sure).otherwise(0) - own).alias("n"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, p, q = (int(x) for x in key)
        part, sets, left, right = _in_blocks(part, p, q)
        weight, n = part["weight"].to_numpy(), np.zeros(len(part), np.int64)
        step = part["step"].fillna(2 * _STEPS).to_numpy()
        for i, hits in _links(sets, left, right, threshold, lambda i, r: step[r] + step[i] > reach):
            n[i] += weight[hits].sum()
            if p != q:
                n[hits] += weight[i]
        return pd.DataFrame({"vid": part["vid"], "n": n})

    compared = rows.join(rows.filter("far").select("group").distinct(), "group", "left_semi").join(texts, "vid")
    found = _blocks(compared).groupBy("group", "p", "q").applyInPandas(run, "vid long, n long")
    return certain.unionByName(found).groupBy("vid").agg(F.sum("n").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """vid and root, the least vid connected to it, for every end of an edge. Alternating large and small stars; each
    round is a table in the shared folder."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        e = both(e)
        low = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return e.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = storage.table(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = state(now)
    while was[0]:
        now = storage.table(small(large(now)), "edges")
        if (is_ := state(now)) == was:
            break
        was = is_
    return now.select(F.col("a").alias("vid"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("vid"), F.col("b").alias("root")).distinct())


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, count_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, vid) of every row; and of every variant: vid, doc_id (its least), copies, class_id, root (the
    least vid of its class, which tells classes apart also where a doc_id is null or repeated) and n_links."""
    found = storage.table(signatures(docs, *choose_bands(threshold, recall)), "signatures")
    variants = storage.table(found.filter("vid is not null").groupBy("vid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "variants")
    keyed = variants.select("vid", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("vid").alias("star"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = storage.table(keyed.join(buckets, "key"), "buckets")
    texts = storage.table(_texts(docs, members.select("vid").distinct()), "texts")

    stars = members.filter("vid != star").select("star", "vid").distinct()
    pairs = stars.join(texts, "vid").join(texts.select(F.col("vid").alias("star"), F.col("text").alias("star_text")), "star")
    checked = storage.table(_verify(pairs, threshold), "checked")
    # a member that isn't similar to its star may be to others of the bucket; equal buckets are compared once
    mixed = members.join(checked.filter("not ok").select("star", "vid"), ["star", "vid"], "left_semi").select("key").distinct()
    same = members.join(mixed, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("vid").bitwiseAND((1 << 40) - 1)).alias("s"), F.bit_xor(F.xxhash64("vid")).alias("x"))
    mixed = storage.table(same.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key"), "mixed")
    whole = members.join(mixed, "key", "left_semi").join(checked, ["star", "vid"], "left")
    whole = whole.select(F.col("key").alias("group"), "vid", F.coalesce("d", F.lit(0.0)).alias("d"), (~F.coalesce("ok", F.lit(True))).alias("far")).join(texts, "vid")
    edges = checked.filter("ok").select(F.col("star").alias("a"), F.col("vid").alias("b")).unionByName(_spanning(whole, threshold))
    roots = storage.table(components(edges), "roots")

    narrow = variants.select("vid", "doc_id", "copies")
    ids = roots.join(narrow, "vid").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classed = roots.join(ids, "root").select("vid", "class_id", "root")
    out = narrow.join(classed, "vid", "left").withColumn("class_id", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))).withColumn("root", F.coalesce("root", "vid"))
    if count_links:
        away = checked.select(F.col("star").alias("root"), "vid", "d")
        group = roots.join(narrow, "vid").join(away, ["root", "vid"], "left")
        group = group.select(F.col("root").alias("group"), "vid", F.col("copies").alias("weight"), F.when(F.col("vid") == F.col("root"), 0.0).otherwise(F.col("d")).alias("d"))
        out = out.join(_degrees(group, texts, threshold), "vid", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).drop("links")
    return found.select("doc_id", "vid"), out


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id (the least doc_id of its class) and n_links, the number of
    other rows that are similar to it. Classes with the same least doc_id, null for one, share their class_id."""
    rows, variants = classes(docs, threshold, recall)
    some = rows.join(variants.select("vid", "class_id", "n_links"), "vid").select("doc_id", "class_id", "n_links")
    none = rows.filter("vid is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay if one row of each class does, that with the least doc_id; all columns. Of
    rows of a class with that doc_id, the one with the least hash of its shingles, then of the row, stays."""
    _, variants = classes(docs, threshold, recall, count_links=False)
    stay = variants.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("vid").alias("__vid"), F.any_value("class_id").alias("__doc"))
    rows = _with_vid(docs, docs.columns)
    own = [F.col(f"`{c}`") for c in docs.columns]
    first = rows.join(stay, "__vid").filter(F.col("doc_id").eqNullSafe(F.col("__doc"))).groupBy("root").agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("__row"))
    return first.select("__row.*").unionByName(rows.filter("__vid is null").drop("__vid"))
