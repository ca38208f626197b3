import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wavespark.llm import words

TEXT = st.text(alphabet="ab \n\t\x0b\x0c\réß日🙂\x00\x1c\xa0", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 20))
def test_words_and_windows(texts, limit):
    want = [re.findall(words.WORD, t or "") for t in texts]
    got, seen, windows = [], {}, []
    for c in words.chunks(pa.array(texts, pa.string()), limit):
        own = [bytes(c.buf[a:b]).decode() for a, b in zip(c.starts, c.ends, strict=True)]
        hashes = c.hashes()
        for w, h in zip(own, hashes, strict=True):
            assert seen.setdefault(w, h) == h
        got += [own[a:b] for a, b in zip(c.word_at[:-1], c.word_at[1:], strict=True)]
        pos, h = c.windows(hashes, 2)
        windows += [(tuple(own[p : p + 2]), x) for p, x in zip(pos, h, strict=True)]
    assert got == want and len(set(seen.values())) == len(seen)
    assert sorted(w for w, _ in windows) == sorted(p for ws in want for p in zip(ws, ws[1:], strict=False))
    assert len({w for w, _ in windows}) == len({x for _, x in windows})


def test_slices_and_long_words():
    a = pa.array(["zero", "one two", None, "x" * 3_000_000 + " y"])[1:]
    (c,) = words.chunks(a, 1 << 30)
    assert c.n_words.tolist() == [2, 0, 2]
    assert len(np.unique(c.hashes())) == 4
    assert c.hashes()[3] == next(words.chunks(pa.array(["y"]))).hashes()[0]


def test_lower_case():
    (c,) = words.chunks(pa.array(["AbC abc É é"]))
    a, b, x, y = c.hashes(lower=True)
    assert a == b and x != y
