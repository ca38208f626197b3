"""Words of texts as numpy arrays, straight from Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. All six separators are ASCII, so a text can be cut as UTF-8 bytes.
Words, lines and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NEWLINE = 10
CHUNK = 1 << 20
_BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
RAW = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=_U)
LOWER = RAW.copy()
LOWER[65:91] = RAW[97:123]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def pair(a: np.ndarray, b) -> np.ndarray:
    """Hash of ordered pairs of 64-bit values."""
    return mix(a * _U(0xD1342543DE82EF95) + b)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _BLOCK)
        inverse = pow(_P, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, x, _U))]) for x in (_P, inverse)]
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = RAW) -> np.ndarray:
    """Hashes of disjoint byte spans in ascending order, by differences of a prefix polynomial. Memory is
    bounded by ``_BLOCK`` or one span."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo)
        sums = np.zeros(hi - lo + 1, _U)
        np.cumsum(table[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(_U))


class Chunk:
    """Some neighbouring rows: bytes ``buf``, row offsets ``at``, and their words."""

    def __init__(self, first: int, buf: np.ndarray, at: np.ndarray):
        self.first, self.buf, self.at, self.rows = first, buf, at, len(at) - 1
        self.inside = ~SPACE[buf]
        self.starts, self.ends = self.spans(self.inside)
        self.word_at = np.searchsorted(self.starts, at)  # first word of each row
        self.n_words = np.diff(self.word_at)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of flagged bytes; no run goes over the end of a row."""
        cut = self.at[:-1][self.at[:-1] < len(inside)]
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[cut] = False
        after[cut[cut > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends, LOWER if lower else RAW)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first word, and hash, of each window of k words that lies in one row."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        row = np.repeat(np.arange(self.rows), self.n_words)
        acc = hashes[:n]
        for j in range(1, k):
            acc = pair(acc, hashes[j : j + n])
        pos = np.flatnonzero(row[:n] == row[k - 1 :])
        return pos, acc[pos]

    def row_sums(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes by row."""
        sums = _sums(flags)
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def word_sums(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes by word."""
        sums = _sums(flags)
        return sums[self.ends] - sums[self.starts]


def _sums(flags: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Cut a column of strings (null: empty) into chunks of rows with about ``limit`` bytes, at least one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Chunk(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j
