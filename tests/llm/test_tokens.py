import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavespark.llm import storage, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 20, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (tokens.unpack(data, bits, 1001) == ids).all() and (tokens.unpack(data, bits, 5, 77) == ids[77:82]).all() and len(tokens.unpack(data, bits, 0)) == 0


def test_bits():
    assert [tokens.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sé²½1 .,!\n\t\r\x0b\x1c\x1f\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000 日🙂_-")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pieces_encode_as_whole_texts(text):
    enc = tokens.encoder(PATH)
    assert enc.encode(text) == enc.whole(text)


@pytest.mark.parametrize("text", ["<|endoftext|> x", "don't we'll", "a  b   c", " lead", "trail ", "x\n\ny", "it's.\nIt's?! ok...", ""])
def test_special_texts(text):
    enc = tokens.encoder(PATH)
    assert enc.splits and enc.encode(text) == enc.whole(text)


def test_other_tokenizers_encode_whole_texts():
    enc = tokens.Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    assert not enc.splits and enc.encode("Hello  World") == enc.whole("Hello  World")


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    enc = tokens.Encoder(PATH)
    text = " ".join(f"word{k % 37}" for k in range(300))
    assert enc.encode(text) == enc.whole(text) and len(enc.pieces) + len(enc.pieces.old) <= 21
    text = "x" * 5000 + " " + "y" * 10
    assert enc.encode(text) == enc.whole(text) and max(map(len, enc.pieces)) <= tokens.LONG


@pytest.mark.parametrize("bits", [16, 17])
def test_files(spark, monkeypatch, bits):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    uri = storage.shared_dir(spark, "ids") + "/f.bin"
    rng = np.random.default_rng(3)
    docs = [(k if k != 2 else None, rng.integers(0, 1 << bits, n).astype(np.uint32)) for k, n in enumerate((0, 10, 64, 500, 1, 128))]
    out = tokens.Writer(uri, bits)
    for d, ids in docs:
        out.add(d, ids)
    out.close()
    read = tokens.Reader(uri)
    whole = np.concatenate([x for _, x in docs])
    assert (read[0 : len(whole)] == whole).all() and (read[100:107] == whole[100:107]).all() and len(read[5:5]) == 0
    ends = np.cumsum([len(x) for _, x in docs])
    assert [tuple(map(lambda v: None if v is None else int(v), r)) for r in read.documents()] == [(d, int(e - len(x)), len(x), zlib.crc32(x.astype("<u4").tobytes())) for (d, x), e in zip(docs, ends, strict=True)]
    assert storage.read_bytes(uri)[:8] == tokens.MAGIC


def test_many_rows_of_one_id(spark, monkeypatch):
    """They span files, and those don't fall apart: equal rows count one by one."""
    monkeypatch.setattr(tokens, "FILE", 50)
    docs = spark.createDataFrame([(None, f"text number {k % 3}") for k in range(300)] + [(1, "x")], "doc_id long, text string").repartition(3)
    files = tokens.write(docs, PATH, storage.shared_dir(spark, "ids"))
    found = sorted(tokens.read(spark, files).collect(), key=lambda r: r["start"])
    assert len(files) > 8 and len(found) == 301 and found[-1]["doc_id"] == 1
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:k]) for k in range(301)]


def test_query(spark, data, awkward, nothing):
    enc = tokens.encoder(PATH)
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), awkward, nothing):
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        want, at = [], 0
        for d, t in rows:
            ids = enc.encode(t) + np.array([0], "<u4").tobytes()
            want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
            at += len(ids) // 4
        found = tokens.read(spark, tokens.write(docs, PATH, storage.shared_dir(spark, "ids")))
        assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[1]) == want
