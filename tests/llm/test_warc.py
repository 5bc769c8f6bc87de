import base64
import hashlib
import random

from quantframe.llm import warc
from quantframe.llm.common import shared_path

LONG = "<p>é</p>" * 40000
ROWS = [(1, "http://a.example.com/x", "same", 1), (7, "https://A.example.com/x#t", "same", 1), (3, None, None, 1), (4, "", "", 1), (None, "http://b.org", "null id", 1), (5, "http://[bad", LONG, 1), (6, "http://ex.com:8080/ö ü?q=1\t", LONG, 1), (9, "u", "once", 1), (9, "u", "once", 1)]


def brute(rows):
    out = []
    for i, _, html, *_ in rows:
        keep = max((j for j, _, h, *_ in rows if (h or "") == (html or "") and j is not None), default=None)
        data = (html or "").encode()
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == keep else "revisit", None if i == keep else keep))
    return sorted(out, key=str)


def test_round_trip_through_index(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, key int")
    folder = shared_path(spark, "warc-test")
    tops = warc.archive_and_index(df, folder, block_lines=2)
    got = warc.lookup(df.select(warc.capture_keys("url", "page_id")), folder, tops).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = shared_path(spark, "warc-test")
    tops = warc.archive_and_index(df, folder)
    assert tops == [] and warc.lookup(df.select(warc.capture_keys("url", "page_id")), folder, tops).collect() == []


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r)[:3] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.query(spark, sf_dir).collect()), key=str) == brute(rows)


def test_lookup_of_a_few_reads_blocks_by_binary_search(spark):
    random.seed(3)
    df = spark.range(2000).selectExpr("id AS page_id", "concat('http://h', id % 5, '.com/', id % 700) AS url", "concat('body ', id % 900) AS html")
    folder = shared_path(spark, "warc-test")
    tops = warc.archive_and_index(df, folder, block_lines=7)
    index, reads = warc.Index(folder, tops), []
    plain, index.range = index.range, lambda *a: reads.append(a) or plain(*a)
    for i in random.sample(range(2000), 50):
        url = f"http://h{i % 5}.com/{i % 700}"
        reads.clear()
        assert [e[0] for e in index.find(warc.capture_key(url, i))] == [warc.capture_key(url, i)] and len(reads) <= 2
    assert index.find("zzz 0") == [] and index.find("") == []


def test_keys():
    assert warc.url_key("https://WWW.Example.com:443/a?b#c") == "com,example,www)/a?b" and warc.url_key(None) == ""
    assert warc.capture_key("http://a.b/", 2) < warc.capture_key("http://a.b/", 10)
