import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wavespark.llm import storage, warc


@pytest.mark.parametrize(("url", "key"), [
    ("http://www.Example.com/a?b=1#top", "com,example)/a?b=1"), ("https://m.example.com:8080", "com,example,m:8080)/"), ("http://example.com:80/", "com,example)/"), ("", ")/"), (None, ")/"),
    ("http://[bad", "http%3A%2F%2F%5Bbad"), ("http://x.org/a b\nc", "org,x)/a%20bc"),
])
def test_keys(url, key):
    assert warc.surt(url) == key


@pytest.mark.parametrize("url", ["http://x.org/x%20y?q=%41", "http://x.org/x y", "http://É.org/é ü", "http://[bad %", " http://u@Www.X.org:80/%zz ", "", None])
def test_keys_of_archived_urls(url):
    assert warc.wire(warc.wire(url)) == warc.wire(url) and warc.surt(warc.wire(url)) == warc.surt(url)


def test_record_round_trip():
    date = "2024-01-01T00:00:00Z"
    head, payload = warc.parse(warc.record("response", "http://x.org/é%20ü\n", -7, b"a\r\n\r\nb", "d1", None, date))
    assert payload == b"a\r\n\r\nb" and head["warc-type"] == "response" and head["x-page-id"] == "-7" and head["warc-target-uri"] == "http://x.org/%C3%A9%20%C3%BC"
    head, payload = warc.parse(warc.record("revisit", "u", None, b"gone", "d1", ("http://y.org/", 9), date))
    assert payload == b"" and head["x-refers-to-page-id"] == "9" and head["warc-refers-to-date"] == date and "x-page-id" not in head


def pages(spark):
    big = "<p>" + "x" * 2000
    rows = [(k, f"http://h{k % 5}.example.com/{k}", f"{k} " * 400) for k in range(60)]
    rows += [(100, "http://a.example.com/", big), (101, "http://b.example.com/", big), (102, "http://b.example.com/", big), (103, "http://c.example.com/", "small"), (104, "http://c.example.com/", "small")]
    rows += [(200, None, None), (201, "http://e.example.com/é", ""), (None, "http://n.example.com/", big), (300, "http://same.example.com/", "y" * 1500), (300, "http://same.example.com/", "y" * 1500)]
    low = "<b>" + "z" * 1500
    rows += [(-5, "http://low.example.com/", low), (-9, "http://low.example.com/x%20y", low), (None, "http://low.example.com/", low), (None, "http://low.example.com/", low), (-3, "http://low.example.com/x%20y", "w" * 70_000)]
    rows += [(-(1 << 62), "http://far.example.com/%41", low + "1"), ((1 << 62) + 1, "http://far.example.com/A", low + "1")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)


def archive(spark, df):
    folder = storage.shared_dir(spark, "warc")
    return warc.write_index(warc.write_archives(df, folder), folder), folder


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    df = pages(spark)
    parts, folder = archive(spark, df)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    best = {}
    for page_id, body in rows:
        if len(body) >= 1000 and page_id is not None:
            best[body] = max(best.get(body, page_id), page_id)
    want = []
    for page_id, body in rows:
        refers = best.get(body) if best.get(body) != page_id else None
        want.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers))
    got = [tuple(r) for r in warc.read_back(spark, parts, folder).drop("url").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)

    index = warc.Index(parts, folder)
    for r in df.filter("url is not null and page_id is not null").collect():
        hits = index.find(r["url"], r["page_id"])
        assert hits and all(h[:2] == (warc.surt(r["url"]), r["page_id"]) for h in hits)
        if hits[0][2] == "response":
            assert index.read(hits[0])[1] == (r["html"] or "").encode()
    assert sorted(h[1] for h in index.find("http://b.example.com/")) == [101, 102] and index.find("http://none.example.com/") == []
    keys = [line[:2] for p in range(len(parts)) for k in range(parts[p]["blocks"]) for line in index.block(p, k)]
    assert keys == sorted(keys, key=lambda x: (x[0], x[1] is not None, x[1] or 0)) and len(keys) == df.count()
    assert [h[1] for h in index.find("http://low.example.com/")] == [None, None, -5] and [h[1] for h in index.find("http://low.example.com/x y")] == [-9, -3]
    assert [h[1] for h in index.find("http://low.example.com/x%20y", -9)] == [-9]


def test_archives_are_plain_gzip(spark):
    df = pages(spark).filter("page_id is null or page_id < 5 or page_id = 300")
    parts, folder = archive(spark, df)
    index = warc.Index(parts, folder)
    files = {line[3] for p in range(len(parts)) for k in range(parts[p]["blocks"]) for line in index.block(p, k)}
    for f in files:
        assert gzip.decompress(storage.read_bytes(f"{folder}/{f}")).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    whole = b"".join(gzip.decompress(storage.read_bytes(f"{folder}/{f}")) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == df.count() + len(files)
    ids = re.findall(rb"WARC-Record-ID: <urn:uuid:(.*?)>", whole)
    assert len(set(ids)) == len(ids) == df.count() + len(files)


def test_empty(spark):
    parts, folder = archive(spark, pages(spark).limit(0))
    assert warc.read_back(spark, parts, folder).count() == 0
