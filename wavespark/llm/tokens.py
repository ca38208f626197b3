"""Token ids as files of fixed-width packed integers.

Every id takes the least number of bits that holds the vocabulary. A file holds the documents of one range of
doc_id in order; its ids are cut into blocks of ``BLOCK`` ids, and the footer has each block's byte offset, so any
id is found by arithmetic and one short read, and a block is unpacked by numpy in one go.

File: ``WSIDS001``, then blocks, then the footer (bits, ids per block, number of ids and documents as int64; block
offsets; doc ids; a byte for each null doc id; end of each document in ids), then the footer's size as int64.

Ranges are found on narrow rows (doc_id, the text's first characters and hash, a number); then texts are encoded where
they are read, and only ids, compressed, are shuffled, once. A doc_id with many rows may span several ranges.

Defined results: a null text is an empty text and has the end id alone. Null doc ids come first; rows with equal
doc ids stay neighbours, ordered by their texts' first characters. Extra columns are ignored. An empty table gives an empty table. Texts
are never cut.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.llm import storage

MAGIC = b"WSIDS001"
BLOCK = 1 << 16
END = 0
#: pieces of text that a worker remembers, twice over, and characters in one at most: so the memory is bounded, too
CACHE, LONG = 700_000, 48
#: bytes of text that make a file, about; there are at least as many files as shuffle partitions. Documents read at once
FILE, ROWS = 1 << 29, 1 << 13


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit order: id k takes bits k * bits up to (k + 1) * bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(wide.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a packed block, each by one unaligned 8-byte load, shift and mask."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[: len(data) + 1].view(), (len(data) + 1, 8), (1, 1))[at >> 3].copy().view("<u8")[:, 0] if n else np.empty(0, np.uint64)
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class _Pieces(dict):
    """Ids of pieces of text; the pieces of two generations of CACHE are kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.pop(piece, None)
        if found is None:
            found = self.encode(piece)
            if len(piece) > LONG:
                return found
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Ids of texts by the tokenizers library.

    A byte-level BPE without normaliser splits a text before it merges: runs of white space but for their last
    character, and words with the blank before them. Cut at the same places, a text's pieces give the ids that the
    whole text gives, and the ids of each piece are remembered. Texts with a special token's string, and all texts of
    tokenizers of other kinds, are encoded whole.
    """

    _SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # fixed values: white space of Unicode
    _PIECE = re.compile(rf" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?]*(?:[{_SPACE}]|\Z))|[.,;:!?]+(?=[{_SPACE}]|\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind["pre_tokenizer"] or {}
        self.special = [x["content"] for x in kind["added_tokens"]]
        self.splits = kind["model"]["type"] == "BPE" and not kind["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind["truncation"] and not kind["padding"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.shown = {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}  # byte-level alphabet
        self.pieces = _Pieces(self._piece)

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():  # one piece to the tokenizer, too
            return np.array([t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))], "<u4").tobytes()
        return self.whole(piece)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32."""
        if not text:
            return b""
        if not self.splits or any(x in text for x in self.special):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, self._PIECE.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Streams ids into one file; memory is one block and the list of documents."""

    def __init__(self, uri: str, bits: int):
        self.store, self.path = storage.resolve(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part, compression=None)
        self.out.write(MAGIC)
        self.bits, self.waiting, self.n_waiting, self.n = bits, [], 0, 0
        self.blocks, self.doc_ids, self.ends = [len(MAGIC)], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n)
        if self.n_waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            data = pack(ids[i : min(i + BLOCK, whole)], self.bits)
            self.out.write(data)
            self.blocks.append(self.blocks[-1] + len(data))
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        null = np.array([x is None for x in self.doc_ids], np.uint8)
        foot = struct.pack("<4q", self.bits, BLOCK, self.n, len(self.ends)) + np.array(self.blocks, "<i8").tobytes() + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + null.tobytes() + np.array(self.ends, "<i8").tobytes()
        self.out.write(foot + struct.pack("<q", len(foot)))
        self.out.close()
        self.store.move(self.part, self.path)


class Reader:
    """Random access to the ids of a file."""

    def __init__(self, uri: str):
        store, path = storage.resolve(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<q", self.file.read_at(8, size - 8))
        foot = self.file.read_at(n, size - 8 - n)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} isn't a file of ids")
        self.bits, self.block, self.n, docs = struct.unpack_from("<4q", foot)
        at = 32
        self.blocks = np.frombuffer(foot, "<i8", -(-self.n // self.block) + 1, at)
        at += self.blocks.nbytes
        self.doc_ids = np.frombuffer(foot, "<i8", docs, at)
        self.null = np.frombuffer(foot, np.uint8, docs, at + 8 * docs)
        self.ends = np.frombuffer(foot, "<i8", docs, at + 9 * docs)

    def _block(self, k: int) -> np.ndarray:
        data = self.file.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k]))
        return unpack(data, self.bits, min(self.block, self.n - k * self.block))

    def __getitem__(self, span: slice) -> np.ndarray:
        lo, hi, _ = span.indices(self.n)
        if hi <= lo:
            return np.empty(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        ids = np.concatenate([self._block(k) for k in range(first, last + 1)])
        return ids[lo - first * self.block : hi - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start, number of ids and CRC-32 of each document, one block in memory at a time."""
        k, block, begin = -1, np.empty(0, np.uint32), 0
        for j, end in enumerate(self.ends):
            at, crc = begin, 0
            while at < end:
                if at // self.block != k:
                    k = at // self.block
                    block = self._block(k).astype("<u4")
                stop = min(int(end), (k + 1) * self.block)
                crc = zlib.crc32(block[at - k * self.block : stop - k * self.block], crc)
                at = stop
            yield (None if self.null[j] else int(self.doc_ids[j])), begin, int(end) - begin, crc
            begin = int(end)


def write(docs: DataFrame, tokenizer: str, folder: str) -> list[tuple[str, int, int]]:
    """Encode every document into files by ascending doc_id. Gives uri, start and number of ids of each file; that
    list has an entry for each partition, not for each document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # equal rows may change places: their numbers only spread them
    keyed = docs.select(F.col("doc_id").cast("long"), F.substring(text, 1, 16).alias("p"), F.xxhash64(text).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), "text")
    narrow = storage.table(keyed.select("doc_id", "p", "h", "salt", F.octet_length(text).alias("n")), "keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (narrow.agg(F.sum("n")).first()[0] or 0) // FILE, 1)
    key = ["doc_id", "p", "h", "salt"]
    ranges = narrow.repartitionByRange(parts, *key).groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct(F.col("doc_id").isNotNull(), *key)).alias("k"))
    bounds = sorted((known, doc_id or 0, p.encode(), h, salt) for known, doc_id, p, h, salt in (r["k"] for r in ranges.collect()))  # one for each part

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        kind = "<u2" if bits_for(enc.vocabulary()) <= 16 else "<u4"
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            part = pa.array([bisect_left(bounds, (d is not None, d or 0, p.encode(), h, salt)) for d, p, h, salt in keys], pa.int32())
            ids, first, held = [], 0, 0

            def rows(end: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([x.slice(first, end - first) for x in (*b.columns[:4], part)] + [pa.array(ids, pa.binary())], [*key, "part", "ids"])  # noqa: B023

            for k, x in enumerate(b.column(4)):
                ids.append(packer.compress(np.frombuffer(enc.encode(x.as_py()), "<u4").astype(kind).tobytes()))
                held += len(ids[-1])
                if held >= 1 << 23:
                    yield rows(k + 1)
                    ids, first, held = [], k + 1, 0
            yield rows(b.num_rows)

    encoded = keyed.mapInArrow(encode, "doc_id long, p string, h long, salt long, part int, ids binary")
    rows = encoded.repartitionById(parts, F.least("part", F.lit(parts - 1))).sortWithinPartitions(*key).select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part = bits_for(encoder(tokenizer).vocabulary()), TaskContext.get().partitionId()
        uri = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.bin"
        out, end, unpacker = None, np.array([END], np.uint32), zstandard.ZstdDecompressor()
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = out or Writer(uri, bits)
                ids = np.frombuffer(unpacker.decompress(ids.as_py()), "<u2" if bits <= 16 else "<u4")
                out.add(doc_id, np.append(ids, end).astype(np.uint32))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "n": pa.array([out.n], pa.int64())})

    files = rows.mapInArrow(run, "part int, uri string, n long").collect()
    files.sort(key=lambda r: r["part"])
    starts = accumulate([0, *(r["n"] for r in files)])
    return [(r["uri"], at, r["n"]) for r, at in zip(files, starts, strict=False)]


def read(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                uri, base, _ = files[k]
                documents = Reader(uri).documents()
                while rows := list(islice(documents, ROWS)):
                    ids, start, n, crc = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array([base + x for x in start], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
