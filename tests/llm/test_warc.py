import base64
import hashlib

from pathgrade.llm import warc

PAGES = [(1, "http://a/", "x" * 1000), (2, None, "é" * 300), (3, "http://b/\r\n", "x" * 1000), (4, "http://c/", None), (5, "http://d/", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "v", "alone"), (7, "w", "x" * 1000)]


def expected():
    first = {}
    for page, _, html in PAGES:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        one = first.get(html or "", page)
        out.append((page or -1, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == one else "revisit", None if page == one else one))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("url", "url").selectExpr("*", "1 as record", "'q' as path")
    got = [(r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(pages, chunk_bytes=64).collect()]
    assert sorted(got, key=str) == expected()
    assert warc.page_records(pages.where("false")).count() == 0


def test_chunks_carry_digests(spark):
    pages = spark.createDataFrame([(1, "u", "abc" * 100)], "page_id long, url string, html string")
    rows = warc.read_chunks(warc.write(pages, chunk_bytes=50), chunk_bytes=50, with_bytes=True).orderBy("chunk").collect()
    data = b"".join(bytes(r.bytes) for r in rows)
    assert data == b"abc" * 100 and max(len(r.bytes) for r in rows) <= 50
    for r in rows:
        assert r.digest_so_far == base64.b32encode(hashlib.sha1(data[: r.bytes_so_far]).digest()).decode()
