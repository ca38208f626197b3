import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavespark.llm import media, storage


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=400))
def test_stored_without_loss(text):
    data = media.payload(text)
    assert len(data) % 192 == 0 and data and data.rstrip(b" ") == text.encode().rstrip(b" ")
    for encode in (media.encode_ppm, media.encode_bmp):
        assert media.decode(encode(data)).tobytes() == data


def plain_resize(image, height, width):
    h, w = image.shape[:2]
    out = np.zeros((height, width, image.shape[2]))
    for i in range(height):
        for j in range(width):
            for y in range(h):
                for x in range(w):
                    a = max(0, min((i + 1) * h / height, y + 1) - max(i * h / height, y)) * max(0, min((j + 1) * w / width, x + 1) - max(j * w / width, x))
                    out[i, j] += a * image[y, x]
    return out / (h * w / height / width)


@pytest.mark.parametrize("size", [(13, 7), (1, 1), (8, 9), (3, 40)])
def test_area_resize(size):
    image = np.random.default_rng(1).integers(0, 256, (*size, 3)).astype(np.uint8)
    assert np.allclose(media.area_resize(image, 8, 9), plain_resize(image, 8, 9))
    assert np.isclose(media.area_resize(image, 5, 4).mean(), image.mean())


def test_netpbm_kinds():
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n010").tolist() == [[[0], [255], [0]], [[255], [0], [255]]]
    assert media.decode(b"P2 2 1 15\n3 15").tolist() == [[[3], [15]]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[[0], [255], [0]]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[[258]]]
    for bad in (b"", b"P6\n2 2\n255\nxx", b"GIF", b"P5 0 1 255\n", b"P6 x", b"BM", b"P2 2 1 15\n3"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_bmp_kinds():
    top_down = bytearray(media.encode_bmp(bytes(range(12)), 2))
    flipped = media.decode(bytes(top_down))
    top_down[22:26] = (-2 & 0xFFFFFFFF).to_bytes(4, "little")
    assert (media.decode(bytes(top_down)) == flipped[::-1]).all()


def test_query_columns(awkward, nothing, monkeypatch):
    monkeypatch.setattr(media, "STACK", 2)
    folder = storage.shared_dir(awkward.sparkSession, "tiles")
    rows = media.features(media.store(awkward), folder).collect()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect() if r["doc_id"] is not None}
    assert len(rows) == awkward.count() == len({(r["tile_file"], r["tile_row"]) for r in rows})
    for r in rows:
        if r["doc_id"] is None:
            continue
        data = media.payload(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len((texts[r["doc_id"]] or "").encode()), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-16:])
        assert r["media_bytes"] > r["payload_bytes"] and len(r["feature"]) == 16
        small = storage.map_array(f"{folder}/{r['tile_file']}")[r["tile_row"]]
        image = media.decode(media.encode_ppm(data)).mean(axis=2, keepdims=True)
        assert small.shape == (8, 9) and (len(data) > 40_000 or np.allclose(small, plain_resize(image, 8, 9)[:, :, 0], atol=1e-3))
    assert media.features(media.store(nothing), folder).count() == 0
    monkeypatch.setattr(media, "SLICE", 1)
    images = {repr(r) for r in media.store(awkward).collect()}
    monkeypatch.undo()
    assert images == {repr(r) for r in media.store(awkward).collect()}
    found = media.features(media.store(awkward), other := storage.shared_dir(awkward.sparkSession, "tiles"))
    assert found.count() == found.count() and {f"{other}/{r['tile_file']}" for r in found.collect()} == {f"{other}/{f}" for f in os.listdir(other.removeprefix("file://"))}
    broken = awkward.sparkSession.createDataFrame([(1, 2, b"junk"), (2, None, None)], "doc_id long, n_bytes long, media binary")
    assert {r["doc_id"]: (r["feature"], r["tile_file"]) for r in media.features(broken, folder).collect()} == {1: (None, None), 2: (None, None)}
