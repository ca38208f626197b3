"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, written as NPY tiles with difference hashes.

``encode_ppm`` and ``encode_bmp`` store bytes as 8-bit samples; ``decode`` reads Netpbm (P1 to P6, 8 and 16 bits,
comments) and uncompressed BMP (8-bit palette, 24 and 32 bits, bottom-up or top-down). ``area_resize`` averages
every target cell over its exact area of the source, by differences of the integral image, so its cost doesn't
depend on the scale. ``difference_hash`` compares neighbouring cells of a 9 x 8 grey tile.

Defined results: a null text is an empty text and gets one row of blanks. Undecodable media raise ``ValueError``
in ``decode``; ``features`` gives null features for them and for nulls. Rows are taken one by one: repeated rows
get equal values and extra columns don't matter. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wavespark.llm import storage

#: bytes in a row of a stored image: 64 pixels of 3 samples
ROW = 192
TILE = (8, 9)
#: tiles in a NPY file at most; bytes of text that a task stores at once, about
STACK = 1 << 16
SLICE = 1 << 24
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def payload(text: str | None) -> bytes:
    """The text as UTF-8 with blanks up to a positive multiple of ROW."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)


def encode_ppm(data: bytes, width: int = ROW // 3) -> bytes:
    """Binary PPM of 8-bit samples; ``data`` has whole rows."""
    return b"P6\n%d %d\n255\n" % (width, len(data) // (3 * width)) + data


def encode_bmp(data: bytes, width: int = ROW // 3) -> bytes:
    """Bottom-up 24-bit BMP whose decoded RGB samples are ``data``; rows are padded to 4 bytes."""
    height = len(data) // (3 * width)
    image = np.frombuffer(data, np.uint8).reshape(height, width, 3)[::-1, :, ::-1].reshape(height, -1)
    body = np.pad(image, ((0, 0), (0, -image.shape[1] % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode(media: bytes) -> np.ndarray:
    """Samples as height x width x channels."""
    if media[:1] == b"P" and media[1:2] in b"123456":
        return _netpbm(media)
    if media[:2] == b"BM":
        return _bmp(media)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(media: bytes) -> np.ndarray:
    kind, at = media[1] - 48, 2
    numbers = []
    for _ in range(2 if kind in (1, 4) else 3):
        if not (m := _TOKEN.match(media, at)) or not m[1].isdigit():
            raise ValueError("bad Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height = numbers[:2]
    most = numbers[2] if len(numbers) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if not (width and height and 0 < most < 65536):
        raise ValueError("bad Netpbm size")
    if kind <= 3:
        rest = re.sub(rb"#[^\n]*", b"", media[at:])
        values = list(re.sub(rb"\s", b"", rest)[:n]) if kind == 1 else rest.split()[:n]
        out = np.array([v - 48 if kind == 1 else int(v) for v in values], np.uint16 if most > 255 else np.uint8)
    else:
        at += 1  # one white space ends the header
        if kind == 4:
            line = -(-width // 8)
            rows = np.frombuffer(media, np.uint8, min(line * height, len(media) - at), at)
            if len(rows) < line * height:
                raise ValueError("short Netpbm")
            out = np.unpackbits(rows.reshape(height, line), axis=1)[:, :width].reshape(-1)
        else:
            size = 2 if most > 255 else 1
            if len(media) - at < n * size:
                raise ValueError("short Netpbm")
            out = np.frombuffer(media, ">u2" if size == 2 else np.uint8, n, at)
    if len(out) < n:
        raise ValueError("short Netpbm")
    if kind in (1, 4):
        out = (1 - out) * 255  # 1 is black
    return out.reshape(height, width, channels)


def _bmp(media: bytes) -> np.ndarray:
    try:
        start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", media, 10)
    except struct.error as e:
        raise ValueError("short BMP") from e
    rows, line = abs(height), -(-width * bits // 32) * 4
    if width <= 0 or not rows or bits not in (8, 24, 32) or packed not in (0, 3) or len(media) < start + rows * line:
        raise ValueError("BMP of an unknown kind")
    body = np.frombuffer(media, np.uint8, rows * line, start).reshape(rows, line)
    body = body[::-1] if height > 0 else body
    if bits == 8:
        palette = np.frombuffer(media, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)
        return palette[body[:, :width], 2::-1]
    return body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source over each target cell's exact area (cells may cut pixels), as float64."""
    sums = image.astype(np.float64)

    def integrate(x: np.ndarray, n: int) -> np.ndarray:
        """Means of n equal spans along axis 0, by interpolating the integral at their borders."""
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        at = np.arange(n + 1) * (len(x) / n)
        low = np.minimum(at.astype(int), len(x) - 1)
        part = (at - low).reshape(-1, *[1] * (x.ndim - 1))
        border = total[low] + part * x[low]
        return np.diff(border, axis=0) * (n / len(x))

    return integrate(integrate(sums, height).swapaxes(0, 1), width).swapaxes(0, 1)


def grey(image: np.ndarray) -> np.ndarray:
    return image.mean(axis=2)


def difference_hash(tile: np.ndarray) -> str:
    """16 hex digits: is each cell of an 8 x 9 tile darker than its right neighbour."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def tile(samples: np.ndarray) -> np.ndarray:
    """Small grey image of any image."""
    return np.round(area_resize(grey(samples), *TILE), 6)


def store(docs: DataFrame, encode=encode_ppm) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text as a stored image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, n, data, held = 0, [], [], 0

            def rows(end: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "n_bytes", "media"])  # noqa: B023

            for k, x in enumerate(b.column(1)):
                raw = x.as_py() or ""
                n.append(len(raw.encode()))
                data.append(encode(payload(raw)))
                held += len(data[-1])
                if held >= SLICE:
                    yield rows(k + 1)
                    first, n, data, held = k + 1, [], [], 0
            yield rows(b.num_rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def features(media: DataFrame, folder: str) -> DataFrame:
    """Read every stored image: digests of its samples and of its stored form, and its difference hash. Grey tiles go
    to NPY files in ``folder``, stacked; tile_file and tile_row say where, null for media that can't be read.

    The result is a table that is written here and now: so tiles are written once, however often it is read. Files
    are named by partition and get their name when whole; a second attempt at a task replaces them by equal ones."""
    call = uuid.uuid4().hex

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 7
        digest = hashlib.sha256(m).hexdigest()
        try:
            samples = decode(m)
        except ValueError:
            return (None, None, None, len(m), digest, None, None)
        data = samples.astype(np.uint8, copy=False).tobytes()
        small = tile(samples)
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), digest, difference_hash(small), small

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_file", "tile_row"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: list[np.ndarray] = []
        own = f"tiles-{call}-{TaskContext.get().partitionId():06d}"
        count = 0

        def flush() -> None:
            nonlocal count
            if tiles:
                storage.write_array(f"{folder}/{own}-{count}.npy", np.stack(tiles).astype(np.float32))
                count += 1
                tiles.clear()

        for b in batches:
            rows = []
            for m in b.column(2):
                *found, small = one(m.as_py())
                if small is None:
                    rows.append((*found, None, None))
                    continue
                rows.append((*found, f"{own}-{count}.npy", len(tiles)))
                tiles.append(small)
                if len(tiles) >= STACK:
                    flush()
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "n_bytes", *names])
        flush()

    kind = media.schema["doc_id"].dataType.simpleString()
    rows = media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_file string, tile_row int")
    return storage.table(rows, "features")
