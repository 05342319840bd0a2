import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from checks.compare import difference
from phrasewell.llm import warc
from phrasewell.llm.oracles import SQL
from phrasewell.llm.queries import QUERIES
from phrasewell.operators.lookup import lookup, salted_join

SF = "/root/testdata/sf0.001"


def test_query_agrees_with_sql(spark):
    assert difference(spark, SF, QUERIES["op10_warc"], SQL["op10_warc"]) is None


def test_odd_pages_go_there_and_back(spark, path, monkeypatch):
    html = ["<p>é漢</p>", "", None, "\r\n\r\nWARC/1.1\r\n", "y" * 3_000_000, "same", "same", "same", "no id", "no id"]
    rows = list(zip([1, 2, 3, 4, 5, 6, 7, 7, None, None], [None, "", "http://a b/\r\nX: y", *["u"] * 7], html))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, payload string, revisit int").repartition(3)
    made = warc.archives(df)
    folder = path if "://" in path else f"file://{path}"
    assert warc.write_files(made, folder).count() == made.count()
    read = spark.read.format("binaryFile").load(folder)
    got = warc.records(read, "path", "content").collect()
    assert len(got) == 10
    texts = {}
    for r in got:
        if r.record_type == "response":
            texts[r.payload_digest] = bytes(r.payload)
            assert len(r.payload) == r.payload_bytes and base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
    assert sorted(texts.values()) == sorted({(h or "").encode() for h in html})
    kinds = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got))
    assert kinds == [(0, "response", 0), (0, "revisit", 0), (1, "response", 0), (2, "revisit", 3), (3, "response", 0), (4, "response", 0),
                     (5, "response", 0), (6, "revisit", 7), (7, "response", 0), (7, "revisit", 7)]
    assert warc.archives(df.limit(0)).count() == 0


def test_frames_and_dictionary():
    words = [f"<html><body class=page><p>text number {i % 7} of many {i}</p></body></html>".encode() * 3 for i in range(300)]
    for compressed in (False, True):
        known = zstandard.train_dictionary(2000, words)
        raw = known.as_bytes()
        stored = zstandard.ZstdCompressor().compress(raw) if compressed else raw
        make = zstandard.ZstdCompressor(dict_data=known)
        content = struct.pack("<II", warc.DICTIONARY_MAGIC, len(stored)) + stored + b"".join(map(make.compress, words))
        assert list(warc.frames(content)) == words
    for cut in (5, len(content) - 3):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(content[:cut]))
    assert list(warc.frames(b"")) == []


def test_faults_are_told(spark):
    good = warc.make_record(1, "u", b"abc", warc.payload_digest(b"abc"), 3, None, False)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), b"", good.replace(b"Content-Length: 3", b"Content-Length: 2")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    files = spark.createDataFrame([("a", bytearray(zstandard.compress(good[:-1])))], "archive string, content binary")
    with pytest.raises(Exception, match="a, record 0"):
        warc.records(files).collect()
    files = spark.createDataFrame([("a", None), ("b", bytearray())], "archive string, content binary")
    assert warc.records(files).collect() == []


def test_digest_in_columns(spark):
    df = spark.createDataFrame([("",), ("abc",), ("é" * 100,)], "t string").select("t", warc.digest_column(F.encode("t", "UTF-8")).alias("d"))
    assert all(r.d == warc.payload_digest(r.t.encode()) for r in df.collect())


def test_a_payload_that_many_pages_share(spark, monkeypatch):
    """With and without a broadcast of the revisits; popular digests are salted."""
    rows = [(i, "u", "shared" if i % 3 else f"own {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    last = max(i for i, _, html in rows if html == "shared")
    for limit in (True, False):
        monkeypatch.setattr(warc, "fits", lambda df, limit=limit: limit)
        monkeypatch.setattr(warc, "lookup", lookup if limit else salted_join)
        got = {r.page_id: r for r in warc.classified(df).collect()}
        assert len(got) == 600
        for i, _, html in rows:
            again = html == "shared" and i != last
            assert (got[i].revisit, got[i].refers_to, bytes(got[i].payload)) == (again, last if again else None, b"" if again else html.encode())
            assert got[i].payload_bytes == len(html) and got[i].payload_digest == warc.payload_digest(html.encode())
