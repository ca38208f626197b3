"""Interpolated modified Kneser-Ney language model in sorted hash arrays.

Counting is a chain of Spark jobs over blocks of packed columns: each task merges what it counts before it sends
anything, and blocks are compressed byte plane by byte plane.

* The vocabulary is the sorted array of the 64-bit hashes of all training words, cut into shards by the hash's top
  bits; a word's id is its place in it. One end token closes each text.
* An entry of order k is the ids of a k-gram's words. Sorted, these shrink to a few bytes; hashes wouldn't. Order N
  has raw counts. Dropping the first word gives the entries of order k - 1, counted by how many different words
  precede them (N - 1 begin symbols stand before each text).
* A shard of order k holds all k-grams of its contexts: sorted k-gram hashes with counts, and sorted context hashes
  with the sum of counts and the numbers of k-grams counted once, twice and more often. The number of shards follows
  the counted tokens, at about SHARD of them each.
* A sorted array is cut into buckets by its hashes' top bits, some eight hashes each, and keeps the next 32 bits of
  each. So an n-gram never seen passes for a seen one about once in 2 ** 29 look-ups. Values are a byte each: the 255
  most frequent ones of the shard, and a sorted list of places for the others.

Workers memory-map the arrays and look tokens up by binary search. Discounts come from the counts of counts of each
order (Chen and Goodman); order 0 is uniform over the vocabulary and one unknown word, so probabilities after any
context add up to 1. Everything grows with the corpus and nothing but counts of counts goes to the driver.

Defined results: a null text is an empty text, with the end token alone. Null doc ids count as empty ids. Repeated
rows are learnt and scored one by one. Extra columns are ignored. With no training text every token has the
probability 1 / (0 + 1). An empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.llm import storage
from wavespark.llm.words import Chunk, chunks, mix, pair

_U = np.uint64
END_HASH = _U(0x656E64206F662074)  # the end token's place in the vocabulary
#: beyond all ids; arbitrary bits, as ``pair`` is linear before it mixes (1 << 63 twice would cancel out: two unknown words
#: would be the context of word 1 twice)
BEGIN, UNKNOWN = _U(0xB5297A4D3F84E1C7), _U(0xC2B2AE3D27D4EB4F)
#: distinct entries that a counting task holds before it sends them on
HELD = 1_500_000
#: training tokens in a shard of n-grams, about; there are at least as many shards as shuffle partitions
SHARD = 1 << 23
HELD_OUT = (7, 2)
#: bytes of text that are counted or scored at once; fewer mean more calls for each shard, and words and n-grams met again
CHUNK = 1 << 22


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


# --- blocks ---


def _planes(a: np.ndarray) -> bytes:
    """Bytes of numbers plane by plane, as many planes as the largest needs; their number comes first."""
    a = np.ascontiguousarray(a, "<u8")
    n = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    return bytes([n]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :n].T).data)


def _from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    for k, plane in enumerate(raw):
        out[:, k] = plane
    return out.view("<u8")[:, 0].astype(_U, copy=False)


def _in_order(columns: list[np.ndarray]) -> np.ndarray:
    """Places of rows by their columns: one number each is sorted, and where its 64 bits don't hold all columns, the
    rows that they leave alike are sorted again."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    packed, room = np.zeros(len(columns[0]), _U), 64
    for c, b in zip(columns, bits, strict=True):
        own = min(b, room)
        packed = (packed << _U(own) if own < 64 else packed) | (c >> _U(b - own) if own else _U(0))
        room -= own
    order = np.argsort(packed)
    if sum(bits) > 64:
        same = packed[order[1:]] == packed[order[:-1]]
        alike = np.flatnonzero(np.append(same, False) | np.append(False, same))
        rows = order[alike]
        order[alike] = rows[np.lexsort([c[rows] for c in columns[::-1]])]
    return order


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """Places by shard, in order within each; 16 bits are sorted by radix."""
    return np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key, by ascending key; for each key its place among them; and how many are alike."""
    order = np.argsort(keys)
    first = np.append(True, keys[order[1:]] != keys[order[:-1]])[: len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    return order[starts], inverse, np.diff(np.append(starts, len(keys)))


def _encode(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows in order of their columns; the first is stored as differences."""
    order = _in_order(columns)
    columns = [c[order] for c in columns]
    parts = [_planes(np.diff(columns[0], prepend=_U(0))), *(_planes(c) for c in columns[1:]), _planes(counts[order])]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _decode(block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n = int(np.frombuffer(block, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(block, "<i8", n, 8).tolist():
        out.append(_from_planes(block[at : at + size]))
        at += size
    return [np.cumsum(out[0], dtype=_U), *out[1:-1]], out[-1]


def _merge(keys: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sum the counts of equal keys; by ascending key."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], [c[order[at]] for c in columns], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _key(columns: list[np.ndarray]) -> np.ndarray:
    return pair(columns[0], columns[-1]) if len(columns) > 1 else mix(columns[0])


def _shard(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Of the longest context, or of the word where there is none."""
    return (mix(columns[0]) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(columns[0]), np.int64)


class _Held:
    """Counts entries within a task and sends them on by shard."""

    def __init__(self, key, shard):
        self.key, self.shard, self.parts, self.n = key, shard, [], 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        counts = np.ones(len(columns[0]), _U) if counts is None else counts.astype(_U)
        part = _merge(self.key(columns), columns, counts)
        self.parts.append(part)
        self.n += len(part[0])
        if self.n > 2 * HELD:
            self._collapse()
            if self.n > HELD:
                yield from self.send()

    def _collapse(self) -> None:
        if len(self.parts) > 1:
            keys, columns, counts = zip(*self.parts, strict=True)
            self.parts = [_merge(np.concatenate(keys), [np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate(counts))]
        self.n = sum(len(p[0]) for p in self.parts)

    def send(self) -> Iterator[tuple[int, bytes]]:
        self._collapse()
        for _, columns, counts in self.parts:
            shard = self.shard(columns)
            order = _by_shard(shard)
            cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(order) else []
            for rows in np.split(order, cuts[1:]) if len(order) else []:
                yield int(shard[rows[0]]), _encode([c[rows] for c in columns], counts[rows])
        self.parts, self.n = [], 0


# --- arrays ---


def _least(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class Arrays:
    """Shards of sorted hashes with values, memory-mapped when first used."""

    def __init__(self, folder: str, name: str, values: str):
        self.at, self.values, self.open = f"{folder}/{name}", values, {}

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            self.open[k] = storage.map_array(f"{self.at}-{k}.npy"), storage.map_array(f"{self.at}-{self.values}-{k}.npy")
        return self.open[k]

    def find(self, shard: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: is it there, its place within its shard, and its values."""
        there, place, out = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), _U)
        order = _by_shard(shard)
        cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(order) else []
        for rows in np.split(order, cuts[1:]) if len(order) else []:
            hashes, values = self.shard(int(shard[rows[0]]))
            if not len(hashes):
                continue
            want = keys[rows]
            at = np.minimum(np.searchsorted(hashes, want), len(hashes) - 1)
            hit = hashes[at] == want
            there[rows], place[rows] = hit, at
            out[rows[hit]] = values[at[hit]]
        return there, place, out


def _blob(arrays: list[np.ndarray]) -> np.ndarray:
    """Arrays one behind the other in one, with their types and shapes in front."""
    head = json.dumps([[a.dtype.str, a.shape] for a in arrays]).encode()
    head = head.ljust(-(-len(head) // 16) * 16)
    parts = [np.array([len(head)], "<i8").tobytes(), head, *(np.ascontiguousarray(a).tobytes() for a in arrays)]
    return np.frombuffer(b"".join(parts), np.uint8)


def _from_blob(blob: np.ndarray) -> list[np.ndarray]:
    at = 8 + int(blob[:8].view("<i8")[0])
    out = []
    for kind, shape in json.loads(blob[8:at].tobytes()):
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out.append(blob[at : at + n].view(kind).reshape(shape))
        at += n
    return out


class Table:
    """One shard's hashes with rows of values."""

    def __init__(self, blob: np.ndarray):
        self.at, self.low, self.code, self.book, self.place, self.rest = _from_blob(np.asarray(blob))  # slices of a memory map itself are slow
        self.bits = (len(self.at) - 1).bit_length() - 1

    @staticmethod
    def build(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of ascending hashes, and a row of values for each."""
        bits = (len(keys) // 8).bit_length()
        at = np.searchsorted(Table.bucket(keys, bits), np.arange((1 << bits) + 1))
        same = values[:, 0]
        for k in range(1, values.shape[1]):
            same = pair(same, values[:, k])
        first, inverse, n = _distinct(same)
        often = np.argsort(-n, kind="stable")[:255]
        code = np.full(len(n), 255, np.uint8)
        code[often] = np.arange(len(often))
        code = code[inverse]
        place = np.flatnonzero(code == 255)
        return _blob([at.astype(np.uint32), Table.rest_of(keys, bits), code, values[first[often]], place.astype(np.uint32), _least(values[place])])

    @staticmethod
    def bucket(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)

    @staticmethod
    def rest_of(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys << _U(bits)) >> _U(32)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key: is it there, and its values; 0 where it isn't."""
        out = np.zeros((len(keys), self.book.shape[1]), _U)
        if not len(self.low):
            return np.zeros(len(keys), bool), out
        own, want = self.bucket(keys, self.bits), self.rest_of(keys, self.bits)
        low, end = self.at.take(own).astype(np.int64), self.at.take(own + 1).astype(np.int64)
        for k in reversed(range(int((end - low).max()).bit_length() if len(keys) else 0)):
            last = low + ((1 << k) - 1)
            less = self.low.take(last, mode="clip") < want
            less &= last < end
            np.add(low, 1 << k, out=low, where=less)
        there = self.low.take(low, mode="clip") == want
        there &= low < end
        at = low[there]
        code = self.code.take(at)
        values = self.book.take(code, axis=0, mode="clip").astype(_U)
        if (far := code == 255).any():
            values[far] = self.rest[np.searchsorted(self.place, at[far])]
        out[there] = values
        return there, out


class Tables:
    """Shards of tables, memory-mapped when first used."""

    def __init__(self, folder: str, name: str):
        self.at, self.open = f"{folder}/{name}", {}

    def find(self, places: np.ndarray, bits: int, keys: np.ndarray, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """By ascending places, whose top bits are the shard and the others in the order of its keys: look-ups go
        through each table from one end to the other."""
        there, out = np.zeros(len(keys), bool), np.zeros((len(keys), width), _U)
        order = None if (places[1:] >= places[:-1]).all() else np.argsort(places)
        shard = _top(places if order is None else places[order], bits)
        keys = keys if order is None else keys[order]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(shard)], strict=True):
            k = int(shard[lo])
            if k not in self.open:
                self.open[k] = Table(storage.map_array(f"{self.at}-{k}.npy"))
            rows = slice(lo, hi) if order is None else order[lo:hi]
            there[rows], out[rows] = self.open[k].find(keys[lo:hi])
        return there, out


def _context_key(context: np.ndarray, bits: int) -> np.ndarray:
    """A hash whose top bits tell a shard's contexts apart; the shard is in the bits above them."""
    return mix(context) << _U(bits)


def _put(folder: str, name: str, k: int, values: str, hashes: np.ndarray, data: np.ndarray) -> None:
    storage.write_array(f"{folder}/{name}-{k}.npy", hashes.astype("<u8"))
    storage.write_array(f"{folder}/{name}-{values}-{k}.npy", data)


# --- counting ---


def _tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a chunk's words, and for each token (words, and one end for each row) its place among
    them; the end token is the last."""
    distinct, inverse = np.unique(c.hashes(lower=True), return_inverse=True)
    return np.append(distinct, END_HASH), np.insert(inverse, c.word_at[1:], len(distinct))


def _grams(ids: np.ndarray, rows: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns of order-grams: ids plus one of their words, the first word first; 0 before a text."""
    out = [ids + _U(1)]
    for j in range(1, order):
        before = np.zeros(len(ids), _U)
        if j < len(ids):
            before[j:] = np.where(rows[j:] == rows[:-j], ids[:-j] + _U(1), _U(0))
        out.insert(0, before)
    return out


def _contexts(grams: list[np.ndarray]) -> list[np.ndarray]:
    """Context hashes of lengths order - 1 to 1, and the id of the last word."""
    *before, word = (np.where(c == 0, BEGIN, c - _U(1)) for c in grams)
    out = [word]
    for k, c in enumerate(reversed(before)):
        out.insert(0, pair(out[0], c) if k else c)
    return out


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _blocks(held: _Held, found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for shard, block in found:
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.binary()), "stats": pa.array([None], pa.string())})


_SCHEMA = "shard int, block binary, stats string"


class Model:
    """What workers need to score: a small description; arrays are opened by each worker."""

    def __init__(self, folder: str, bits: int, order: int):
        self.folder, self.bits, self.gram_bits, self.order = folder, bits, bits, order
        self.offsets = np.zeros(1 << bits, _U)
        self.words, self.tokens = 0, 0
        self.discounts: dict[int, list[float]] = {}
        self.bottom = (0, 0.0)
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def arrays(self, name: str, values: str) -> Arrays:
        return self._open.setdefault(name, Arrays(self.folder, name, values))

    def tables(self, name: str) -> Tables:
        return self._open.setdefault(name, Tables(self.folder, name))

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts of word hashes."""
        shard = _top(hashes, self.bits)
        there, place, count = self.arrays("words", "n").find(shard, hashes)
        return np.where(there, self.offsets[shard] + place.astype(_U), UNKNOWN), count

    def probabilities(self, ids: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token after those before it, by ids of distinct words, the tokens' places among them, and the first
        tokens of texts. Every window of 1 to ``order`` words is looked up once."""
        total, weight = self.bottom
        words, bits = np.append(ids, BEGIN), self.gram_bits
        seq = np.insert(place, np.repeat(first, self.order - 1), len(ids))
        hashes, at = words, seq  # of the distinct windows; which of them ends at each token
        own = mix(words)
        n = self.tables("g1").find(own, bits, own)[1][:, 0]
        uniform = 1 / (self.words + 1)
        p = (np.maximum(n - self._off(1, n), 0) + weight * uniform) / total if total else np.full(len(words), uniform)
        for k in range(2, self.order + 1):
            places = mix(hashes)
            known, stats = self.tables(f"c{k}").find(places, bits, places << _U(bits), 4)
            stats = np.where(known[:, None], stats, _U(1)).astype(float)
            share = stats[:, 1:] @ np.array(self.discounts[k]) / stats[:, 0]
            context = np.roll(at, 1)
            keys = pair(hashes[context], words[seq])
            places = (places >> _U(64 - bits) << _U(64 - bits))[context] | keys >> _U(bits) if bits else keys
            some, inverse, _ = _distinct(places)
            context = context[some]
            n = self.tables(f"g{k}").find(places[some], bits, keys[some])[1][:, 0]
            longer = np.maximum(n - self._off(k, n), 0) / stats[context, 0] + share[context] * p[at[some]]
            p = np.where(known[context], longer, p[at[some]])
            if k < self.order:
                hashes = pair(hashes[at[some]], words[np.roll(seq, k - 1)[some]])
            at = inverse
        return p[at[seq < len(ids)]]

    def _off(self, k: int, n: np.ndarray) -> np.ndarray:
        return np.array([0, *self.discounts[k]])[np.minimum(n, _U(3)).astype(int)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """For counts 1, 2 and more. Where a count of counts is 0 the estimate is not defined; half a count is taken."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * high / low if low and n1 and n2 else 0.5
        out.append(min(max(d, 0.01), k))
    return out


def train(docs: DataFrame, order: int = 3, folder: str | None = None) -> Model:
    """Learn from all rows of ``docs`` (doc_id and text)."""
    spark = docs.sparkSession
    folder = folder or storage.shared_dir(spark, "lm")
    word_bits = bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    model = Model(folder, bits, order)
    texts = docs.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(lambda c: c[0], lambda c: _top(c[0], word_bits))
        for b in batches:
            for c in chunks(b.column(0), CHUNK):
                distinct, at = _tokens(c)
                yield from _blocks(held, held.add([distinct], np.bincount(at, minlength=len(distinct))))
        yield from _blocks(held, held.send())

    def write_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        columns, counts = zip(*map(_decode, rows["block"]), strict=True)
        hashes, _, n = _merge(np.concatenate([c[0] for c in columns]), [], np.concatenate(counts))
        hashes, n = hashes[n > 0], n[n > 0]
        _put(folder, "words", int(key[0]), "n", hashes, _least(n))
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(hashes)], "total": [int(n.sum())]})

    sizes = {r["shard"]: r for r in texts.mapInArrow(count_words, _SCHEMA).groupBy("shard").applyInPandas(write_words, "shard int, n long, total long").collect()}
    at = 0
    for k in range(1 << bits):
        model.offsets[k] = at
        if k in sizes:
            at += sizes[k]["n"]
            model.tokens += sizes[k]["total"]
        else:
            _put(folder, "words", k, "n", np.empty(0, _U), np.empty(0, np.uint16))
    model.words = at

    model.gram_bits = bits = max(bits, (model.tokens // SHARD).bit_length())

    def entries() -> _Held:
        return _Held(lambda c: _key(_contexts(c)), lambda c: _shard(_contexts(c), bits))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = entries()
        for b in batches:
            for c in chunks(b.column(0), CHUNK):
                distinct, place = _tokens(c)
                ids, _ = model.ids(distinct)
                rows = np.repeat(np.arange(c.rows), c.n_words + 1)
                yield from _blocks(held, held.add(_grams(ids[place], rows, order)))
        yield from _blocks(held, held.send())

    def write_grams(k: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            shard = int(key[0])
            if shard < 0:
                return rows
            columns, counts = zip(*map(_decode, rows["block"]), strict=True)
            columns = [np.concatenate(c) for c in zip(*columns, strict=True)]
            keys, columns, n = _merge(_key(_contexts(columns)), columns, np.concatenate(counts))
            storage.write_array(f"{folder}/g{k}-{shard}.npy", Table.build(keys, n[:, None]))
            of = [int((n == j).sum()) for j in (1, 2, 3, 4)]
            stats = {"order": k, "shard": shard, "n": of, "entries": len(n), "total": int(n.sum())}
            out = [(-1, None, json.dumps(stats))]
            if k > 1:
                ctx = _context_key(_contexts(columns)[0], bits)
                by_context = np.argsort(ctx)
                ctx, m = ctx[by_context], n[by_context]
                first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
                sums = [np.add.reduceat(x, first) for x in (m, (m == 1).astype(_U), (m == 2).astype(_U), (m > 2).astype(_U))]
                storage.write_array(f"{folder}/c{k}-{shard}.npy", Table.build(ctx[first], np.stack(sums, 1)))
                held = entries()
                out += [(s, b, None) for s, b in [*held.add(columns[1:]), *held.send()]]
            return pd.DataFrame(out, columns=["shard", "block", "stats"])

        return run

    chain = texts.mapInArrow(count_grams, _SCHEMA)
    for k in range(order, 0, -1):
        chain = chain.groupBy("shard").applyInPandas(write_grams(k), _SCHEMA)
    found = [json.loads(r["stats"]) for r in chain.select("stats").collect()]  # one for each shard and order
    for k in range(1, order + 1):
        own = [x for x in found if x["order"] == k]
        model.discounts[k] = discounts(*(sum(x["n"][j] for x in own) for j in range(4)))
        for missing in {*range(1 << bits)} - {x["shard"] for x in own}:
            for name, width in ((f"g{k}", 1), (f"c{k}", 4))[: 1 + (k > 1)]:
                storage.write_array(f"{folder}/{name}-{missing}.npy", Table.build(np.empty(0, _U), np.empty((0, width), _U)))
        if k == 1:
            n1, n2 = (sum(x["n"][j] for x in own) for j in (0, 1))
            more = sum(x["entries"] for x in own) - n1 - n2
            model.bottom = (sum(x["total"] for x in own), float(np.dot([n1, n2, more], model.discounts[1])))
    return model


def _opened(model: Model) -> Model:
    """The worker's own copy, with arrays that stay open between tasks; those of the model before are let go."""
    if model.folder not in _cache:
        _cache.clear()
    return _cache.setdefault(model.folder, model)


_cache: dict[str, Model] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score and perplexity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wavespark.llm.lm import _opened

        own = _opened(model)
        for b in batches:
            for c in chunks(b.column(2), CHUNK):
                distinct, place = _tokens(c)
                ids, counts = own.ids(distinct)
                first = c.word_at[:-1] + np.arange(c.rows)
                logs = np.log10(own.probabilities(ids, place, first))
                base = np.log10((counts + 1.0) / (own.tokens + own.words + 1))[place]
                total = np.add.reduceat(logs, first)
                n = c.n_words + 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.rows), b.column(1).slice(c.first, c.rows), pa.array(n, pa.int64()), pa.array(np.add.reduceat((counts > 0)[place].astype(np.int64), first), pa.int64()), pa.array(np.full(c.rows, own.tokens), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(total), pa.array(10 ** np.minimum(-total / n, 300))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
