"""VCD files: ``spark.read.format("vcd")`` gives transitions, with option("table", "signals") the signals.

A file is read in byte ranges. The driver looks at the header once; a range's reader starts at the first time mark
within it, and reads on to the first one after its end. What stands before the first time mark belongs to time 0 and
to the first range. seq is the byte offset, so it orders records across ranges.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavespark.model import SIGNALS, TRANSITIONS

SPLIT = 32 << 20
#: records in an Arrow batch
BATCH = 1 << 14


class VcdError(ValueError):
    pass


def _open(path: str):
    """A local path, or a URI of any store that Arrow reads."""
    if "://" not in path:
        return open(path, "rb")
    import io

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return io.BufferedReader(store.open_input_file(at), 1 << 20)


def _size(path: str) -> int:
    with _open(path) as f:
        return f.seek(0, os.SEEK_END)


def header(path: str) -> tuple[list[tuple], str, int]:
    """Signals (path, name, width, type, signal_id), timescale, and the offset at which values begin."""
    scope: list[str] = []
    signals, timescale = [], ""
    with _open(path) as f:
        words = _words(f)
        for word, _ in words:
            if word == "$enddefinitions":
                for w, at in words:
                    if w == "$end":
                        return signals, timescale, at + 4
            elif word in ("$scope", "$var", "$timescale", "$upscope"):
                body = []
                for w, _ in words:
                    if w == "$end":
                        break
                    body.append(w)
                if word == "$scope" and len(body) > 1:
                    scope.append(body[1])
                elif word == "$upscope" and scope:
                    scope.pop()
                elif word == "$timescale":
                    timescale = "".join(body)
                elif word == "$var":
                    if len(body) < 4 or not body[1].isdigit():
                        raise VcdError(f"bad $var: {' '.join(body)}")
                    full = ".".join([*scope, body[3]]).removeprefix("TOP.")
                    signals.append((full, full.rpartition(".")[2], int(body[1]), body[0], body[2]))
    return signals, timescale, _size(path)


def _words(f) -> Iterator[tuple[str, int]]:
    at = 0
    for line in f:
        for m in re.finditer(rb"\S+", line):
            yield m[0].decode("latin-1"), at + m.start()
        at += len(line)


def records(path: str, known: frozenset[str], begin: int, end: int, first: bool) -> Iterator[tuple]:
    """(signal_id, t, seq, v) of the time marks that start in [begin, end), and what follows each."""
    t, on = 0, first
    with _open(path) as f:
        at = begin
        if not first and begin:
            f.seek(begin - 1)
            at = begin - 1 + len(f.readline())  # a range owns the lines that begin in it
        else:
            f.seek(begin)
        comment = False
        for line in f:
            here, at = at, at + len(line)
            s = line.strip().decode("latin-1")
            if comment or s.startswith("$"):
                comment = ("$comment" in s or comment) and "$end" not in s
                continue
            if s.startswith("#"):
                if here >= end:
                    return
                if not s[1:].strip().isdigit():
                    raise VcdError(f"bad time {s!r} at byte {here}")
                t, on = int(s[1:]), True
            elif s and on:
                if s[0] in "bBrR":
                    value, _, name = s.partition(" ")
                    name = name.strip()
                else:
                    value, name = s[0], s[1:].strip()
                if name in known:
                    yield name, t, here, value


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: bool):
        self.path, self.begin, self.end, self.first = path, begin, end, first


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, split: int):
        self.path, self.table, self.split = path, table, split
        signals, self.timescale, self.start = header(path)
        # readers go to each task: only with what their table needs
        self.signals, self.wanted = (signals, frozenset()) if table == "signals" else ([], frozenset(s[4] for s in signals))

    def pushFilters(self, filters):
        """Equality and membership on signal_id are done here; the rest goes back to Spark."""
        for f in filters:
            kind = type(f).__name__
            if self.table == "transitions" and kind in ("EqualTo", "In") and tuple(f.attribute) == ("signal_id",):
                self.wanted &= frozenset([f.value] if kind == "EqualTo" else f.value)
            yield f

    def partitions(self):
        size = _size(self.path)
        if self.table == "signals":
            return [_Range(self.path, 0, 0, True)]
        cuts = list(range(self.start, max(size, self.start + 1), self.split))
        return [_Range(self.path, b, min(b + self.split, size) if k < len(cuts) - 1 else size, k == 0) for k, b in enumerate(cuts)]

    def read(self, part):
        if self.table == "signals":
            yield from self.signals
        else:
            found = records(part.path, self.wanted, part.begin, part.end, part.first)
            while rows := list(islice(found, BATCH)):
                name, t, at, value = (list(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(t, pa.int64()), pa.array(at, pa.int64()), pa.array(value, pa.string()), pa.array([False] * len(rows), pa.bool_())], ["signal_id", "t", "seq", "v", "glitch"])


class VcdSource(DataSource):
    """Options: path, table (transitions or signals), split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "vcd"

    def schema(self) -> str:
        return SIGNALS if self.options.get("table") == "signals" else TRANSITIONS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("table", "transitions"), int(self.options.get("split", SPLIT)))
