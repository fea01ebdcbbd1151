import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import warc

LONG = "<p>é</p>" * 300


def pages(spark):
    rows = [(i, f"http://h{i % 5}.Example.com/p{i}?q=1", f"<p>{i}</p>" * (i + 1), "x") for i in range(40)]
    rows += [(50, "https://a.org/x", LONG, "x"), (51, "https://a.org/y", LONG, "x"), (51, "https://a.org/y", LONG, "x"),
             (52, None, None, "x"), (None, "no scheme", LONG, "x"), (53, "http://t\tab/\n\\n", "", "x")]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")


def test_every_page_comes_back(spark):
    rows, df = pages(spark)
    archive = warc.write_archive(df.repartition(4))
    found = warc.read_all(archive, payloads=True).collect()
    want = []
    for page, url, html, _ in rows:
        body = (html or "").encode()
        revisit = html == LONG and page != 51
        want.append((None if page is None else str(page), len(body), hashlib.sha1(body).hexdigest(),
                     "revisit" if revisit else "response", "51" if revisit else None, b"" if revisit else body))
    got = [(r["page"], r["size"], r["digest"], r["kind"], r["refers"], bytes(r["payload"])) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lookup_reads_the_blocks_that_hold_a_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    _, df = pages(spark)
    archive = warc.write_archive(df)
    assert archive.directory.agg(F.sum("lines")).first()[0] == df.count() and archive.directory.count() > 5
    wanted = spark.createDataFrame([("http://h3.example.com/p3?q=1",), ("https://a.org/y",), ("http://gone/",), (None,)],
                                   "url string")
    searched = warc.lookup(archive, wanted)
    got = sorted(map(str, warc.read_records(searched).select("page").collect()))
    assert got == sorted(map(str, df.where("page_id IN (3, 51, 52)").select(F.col("page_id").cast("string").alias("page")).collect()))
    monkeypatch.setattr(warc, "DIRECTORY_ROWS", 1)
    assert sorted(map(str, warc.read_records(warc.lookup(archive, wanted)).select("page").collect())) == got


@pytest.mark.parametrize("url, key", [
    ("http://Www.Example.com/a?b#c", "com,example,www)/a?b#c"), ("https://u:p@x.org:8080", "org,x:8080)/"), (None, ""),
    ("plain", "plain")])
def test_index_key(url, key):
    assert warc.index_key(url) == key


def test_records_are_gzip_members():
    one = warc.record("response", "7", "http://a/\r\nX: y", "d", 3, b"abc", None)
    assert zlib.decompress(one, 31).startswith(b"WARC/1.1\r\n")
    fields, payload = warc.parse(one)
    assert payload == b"abc" and fields["WARC-Target-URI"] == "http://a/  X: y" and "X" not in fields


def test_empty_table(spark):
    _, df = pages(spark)
    archive = warc.write_archive(df.limit(0))
    assert warc.read_all(archive).collect() == []
    assert warc.lookup(archive, df.select("url")).collect() == []
