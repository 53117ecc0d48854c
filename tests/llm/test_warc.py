import gzip
import hashlib
from base64 import b32encode

from pyspark.sql import functions as F

from pregame.llm.warc import look_up, parse, record, reversed_host_key, write_archive

from .cases import sort_rows

PAGES = [
    (1, "https://www.Example.com/a?x=1#top", "<p>é</p>"), (2, "http://b.example.com:8080/", "<p>é</p>"), (3, "http://example.com", None),
    (4, None, ""), (None, "http://example.com/n", "<p>é</p>"), (None, "http://example.com/only", "no id"), (5, "http://x.org/\nz", "same"),
    (5, "http://x.org/\nz", "same"), (6, "http://x.org/2", "same"), (7, "http://x.org/3", "long " * 50_000), (8, "rel/path", "q"),
    (9, "http://x.org/3", "other capture"),
]


def expected(pages):
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        ids = [i for i, _, h in pages if (h or "") == (html or "") and i is not None]
        keeper = min(ids, default=None)
        revisit = keeper is not None and page_id != keeper
        out.append((page_id, len(payload), b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if revisit else "response", keeper if revisit else None))
    return sort_rows(out)


def frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("part", F.lit("x"))


def test_archives_give_back_every_page(spark, tmp_path):
    pages = frame(spark, PAGES)
    archive = write_archive(pages, folder=f"file://{tmp_path}", block_lines=2, file_bytes=400)
    found = look_up(archive, pages)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sort_rows(found.select(columns).collect()) == expected(PAGES)
    files = sorted(tmp_path.rglob("*.warc.gz"))
    assert len(files) > 3
    read = sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files)
    assert read == len(PAGES)


def test_lookup_by_url_finds_all_captures(spark, tmp_path):
    archive = write_archive(frame(spark, PAGES), folder=f"file://{tmp_path}", block_lines=1)
    asked = spark.createDataFrame([("http://X.org/3",), ("http://nowhere.org/",), ("http://x.org/3",)], "url string")
    rows = look_up(archive, asked).collect()
    assert sort_rows((r.page_id, r.payload) for r in rows) == sort_rows([(7, "long " * 50_000), (9, "other capture")])


def test_small_payloads_are_not_revisits(spark, tmp_path):
    archive = write_archive(frame(spark, PAGES), folder=f"file://{tmp_path}", min_bytes=6)
    kinds = {r.page_id: r.record_type for r in look_up(archive, frame(spark, PAGES)).collect()}
    assert kinds[6] == "response" and kinds[2] == "revisit"


def test_no_pages(spark, tmp_path):
    none = frame(spark, PAGES).limit(0)
    assert look_up(write_archive(none, folder=f"file://{tmp_path}"), none).collect() == []


def test_keys(spark):
    urls = ["https://user@www.Example.com:8080/a?b#c", "http://example.com", "//a.b/c", "x/y", None, ""]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(reversed_host_key(F.col("url"))).collect()
    assert [r[0] for r in got] == ["com,example,www:8080)/a?b", "com,example)/", "b,a)/c", ")x/y", "-", ")/"]


def test_a_damaged_payload_is_noticed():
    raw = record(1, "http://a.b/", b"payload", None, "2024-01-01T00:00:00Z")
    assert parse(raw)["payload"] == "payload"
    try:
        parse(raw.replace(b"payload\r\n", b"paYload\r\n"))
    except ValueError:
        return
    raise AssertionError("not noticed")
