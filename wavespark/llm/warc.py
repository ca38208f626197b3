"""WARC archives with a two-level capture index.

Archives: WARC/1.1, a gzip member for each record, the first of a file being its warcinfo. Of records with equal
payloads of REVISIT_FROM bytes or more, that with the largest page_id is a response; the others are revisits without
payload that name its URL, date and page. URLs are percent-encoded, and what is so already stays; tabs and line ends
in them go, as in browsers. Record ids are unique; page ids stand in a field of their own.

Index: a line ``key page_id type archive offset length`` for each capture, key being the URL with its host
reversed (``com,example)/path``), sorted by key and page_id (null first, written as ``-``), in zlib blocks of BLOCK lines. A part of the index
holds a range of keys in one file; its footer, the sparse directory, has the first (key, page_id) and place of each
block. A look-up searches the parts' first keys, then one directory, then one block, and range-reads one record.

Digests are found before records are written, by a narrow aggregation; only (page_id, digest) rows meet by digest.

Payloads of revisits meet their response's id in one join by (page_id, digest); where the revisits outgrow a broadcast
it moves every payload through one shuffle.

Defined results: a null html is an empty payload; a null URL is written as an empty one. Null page ids sort first
and are never preferred as response; page ids may be negative. Rows that share page_id, URL and payload are written one by one; with the
largest page_id each of them is a response. Extra columns are ignored. An empty table gives an empty table. Nothing
is cut: payloads of any length are stored whole.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.llm import storage

REVISIT_FROM = 1000
BLOCK = 1000
#: bytes after which a task begins its next archive
ARCHIVE = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: captures in a part of the index, about; there are at least a quarter as many parts as shuffle partitions
PART = 4_000_000
_URI = "!#$%&'()*+,-./:;=?@[]_~"


def wire(url: str | None) -> str:
    """A URL as archives have it; the same for what is so already."""
    return quote(re.sub(r"[\t\r\n]", "", (url or "").strip()), safe=_URI)


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; no scheme, fragment, user or ``www.``."""
    url = wire(url)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(url.lower(), safe="")
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key, safe="!$&'()*+,-./:;=?@_~%")


def _framed(head: list[str], body: bytes) -> bytes:
    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}"])
    return gzip.compress(text.encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def info(name: str, date: str) -> bytes:
    """The warcinfo record of an archive, gzipped."""
    body = f"software: wavespark\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    return _framed(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], body)


def record(kind: str, url: str, page_id, payload: bytes, digest: str, refers: tuple[str, int] | None, date: str) -> bytes:
    """One WARC record, gzipped."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        body += payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {wire(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {wire(refers[0])}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers[1]}"]
    return _framed(head, body)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a gzipped record and its payload (without the HTTP head)."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and resp_id and resp_url of the response of pages that only revisit it."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("big", F.octet_length("payload") >= REVISIT_FROM)
    narrow = rows.filter("big").select("page_id", "url", "digest")
    best = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("r"), F.count("*").alias("n")).filter("n > 1")
    copies = narrow.select("page_id", "digest").distinct().join(best, "digest").filter("r.page_id is not null and not (page_id <=> r.page_id)")
    copies = storage.table(copies.select("page_id", "digest", F.col("r.page_id").alias("resp_id"), F.col("r.url").alias("resp_url")), "revisits")
    return rows.join(copies.withColumnRenamed("page_id", "own_id").withColumnRenamed("digest", "own_digest"), F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left").drop("own_id", "own_digest", "big")


def write_archives(pages: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write all records; a table of captures: key, page_id, kind, archive, offset, length. ``date``: of the captures;
    now by default."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        out = None
        for b in batches:
            captures = []
            for page_id, url, payload, digest, resp_id, resp_url in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if out is None:
                    name = f"part-{part:06d}-{count:04d}-{uuid.uuid4().hex}.warc.gz"
                    store, path = storage.resolve(f"{folder}/{name}")
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    at = out.write(info(name, date))
                    count += 1
                kind = "response" if resp_id is None else "revisit"
                data = record(kind, url, page_id, payload, digest, None if resp_id is None else (resp_url, resp_id), date)
                out.write(data)
                captures.append((surt(url), page_id, kind, name, at, len(data)))
                at += len(data)
                if at >= ARCHIVE:
                    out.close()
                    out = None
            columns = list(zip(*captures, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["key", "page_id", "kind", "archive", "offset", "length"])
        if out:
            out.close()

    rows = marked(pages).select(F.col("page_id").cast("long"), "url", "payload", "digest", F.col("resp_id").cast("long"), "resp_url")
    return storage.table(rows.mapInArrow(run, "key string, page_id long, kind string, archive string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> list[dict]:
    """Write the index parts. Gives each part's uri, first key and number of blocks: an entry for each partition."""
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, captures.count() // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri = f"{folder}/index-{part:06d}-{uuid.uuid4().hex}"
        out, lines, directory, at = None, [], [], 0

        def block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(x[1] for x in lines).encode(), 6)
            out.write(data)
            directory.append([*lines[0][0], at, len(data)])  # key, page_id, place, size
            at += len(data)
            lines.clear()

        for b in batches:
            for key, page_id, *rest in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if out is None:
                    store, path = storage.resolve(uri)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                lines.append(((key, page_id), " ".join(map(str, (key, "-" if page_id is None else page_id, *rest)))))
                if len(lines) >= BLOCK:
                    block()
        if out:
            if lines:
                block()
            foot = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(foot + struct.pack("<q", len(foot)))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "key": [directory[0][0]], "id": pa.array([directory[0][1]], pa.int64()), "blocks": pa.array([len(directory)], pa.int32())})

    rows = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    found = rows.mapInArrow(run, "part int, uri string, key string, id long, blocks int").collect()
    return [r.asDict() for r in sorted(found, key=lambda r: r["part"])]


def _place(key: str, page_id: int | None) -> tuple:
    """Sorts captures as the index has them."""
    return key, page_id is not None, page_id or 0


class Index:
    """Look-ups in the capture index, with a few directories, blocks and archives kept open."""

    def __init__(self, parts: list[dict], folder: str):
        self.parts, self.folder = parts, folder
        self.first = [_place(p["key"], p["id"]) for p in parts]
        self.kept: OrderedDict = OrderedDict()

    def _keep(self, key, make, most: int = 64):
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = make()
            if len(self.kept) > most:
                self.kept.popitem(last=False)
        return self.kept[key]

    def _file(self, uri: str):
        def open_():
            store, path = storage.resolve(uri)
            return store.open_input_file(path)

        return self._keep(("file", uri), open_)

    def directory(self, part: int) -> list:
        def load():
            f = self._file(self.parts[part]["uri"])
            (n,) = struct.unpack("<q", f.read_at(8, f.size() - 8))
            return json.loads(zlib.decompress(f.read_at(n, f.size() - 8 - n)))

        return self._keep(("directory", part), load)

    def block(self, part: int, k: int) -> list[tuple]:
        """Captures (key, page_id, kind, archive, offset, length)."""

        def load():
            *_, at, n = self.directory(part)[k]
            lines = zlib.decompress(self._file(self.parts[part]["uri"]).read_at(n, at)).decode().split("\n")
            return [(x[0], None if x[1] == "-" else int(x[1]), x[2], x[3], int(x[4]), int(x[5])) for x in (line.split(" ") for line in lines)]

        return self._keep(("block", part, k), load)

    def find(self, url: str, page_id: int | None = None) -> list[tuple]:
        """All captures of a URL, or of one page of it: binary search in parts, directory and block."""
        key = surt(url)
        low, high = ((key,), (key, 2)) if page_id is None else (_place(key, page_id),) * 2
        out = []
        for part in range(max(0, bisect_left(self.first, low) - 1), bisect_right(self.first, high)):
            firsts = [_place(x[0], x[1]) for x in self.directory(part)]
            for k in range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high)):
                lines = self.block(part, k)
                keys = [_place(*x[:2]) for x in lines]
                out += lines[bisect_left(keys, low) : bisect_right(keys, high)]
        return out

    def read(self, capture: tuple) -> tuple[dict[str, str], bytes]:
        """Range-read one record."""
        return parse(self._file(f"{self.folder}/{capture[3]}").read_at(capture[5], capture[4]))


def read_back(spark: SparkSession, parts: list[dict], folder: str) -> DataFrame:
    """page_id, url (as archived), payload_bytes, payload_digest, record_type, refers_to of each capture, from index and archives.
    A revisit's payload is that of the response it names, found through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(parts, folder)
        known: OrderedDict[tuple, tuple[int, str]] = OrderedDict()

        def full(url: str, page_id: int, digest: str) -> tuple[int, str]:
            if (url, page_id, digest) not in known:
                for capture in index.find(url, page_id):
                    if capture[2] == "response":
                        payload = index.read(capture)[1]
                        if (d := hashlib.sha1(payload).hexdigest()) == digest:
                            known[url, page_id, digest] = len(payload), d
                            break
                else:
                    raise ValueError(f"no response {page_id} for {url}")
                if len(known) > 10_000:
                    known.popitem(last=False)
            return known[url, page_id, digest]

        for b in batches:
            for part, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for capture in index.block(part, k):
                    head, payload = index.read(capture)
                    refers = None
                    if head["warc-type"] == "revisit":
                        refers = int(head["x-refers-to-page-id"])
                        size, digest = full(head["warc-refers-to-target-uri"], refers, head["warc-payload-digest"].removeprefix("sha1:"))
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    own = head.get("x-page-id")
                    rows.append((None if own is None else int(own), head["warc-target-uri"], size, digest, head["warc-type"], refers))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    each = spark.createDataFrame([(k, p["blocks"]) for k, p in enumerate(parts)], "part int, n int").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    return each.repartition(max(1, min(sum(p["blocks"] for p in parts), int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
