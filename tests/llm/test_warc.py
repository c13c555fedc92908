import base64
import hashlib

import pytest

from mergetide.llm import warc
from mergetide.llm.common import new_path


@pytest.fixture
def pages(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://b/3", "<p>same</p>"), (4, None, None), (5, "http://c/\r\nX: y", ""),
        (6, "http://c/6", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb\r\n\r\n"), (None, "http://d", "<p>same</p>"), (7, "http://e", "é" * 200_000), (8, "u", "x"), (8, "u", "x"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")


def test_round_trip(spark, pages):
    path = new_path(spark, "test")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    html = sorted((r.page_id or -1, (r.html or "").encode()) for r in pages.collect())
    assert len(got) == len(html)
    payload = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert sorted((r.page_id or -1, payload[r.refers_to if r.record_type == "revisit" else r.page_id]) for r in got) == html


def test_revisits(pages):
    rows = warc.archive(pages).collect()
    by = {r.page_id: r for r in rows}
    assert (by[1].record_type, by[1].refers_to, by[2].refers_to, by[3].record_type, by[3].refers_to) == ("revisit", 3, 3, "response", None)
    assert by[4].refers_to == 5 and by[4].payload_bytes == 0 and by[None].record_type == "response"
    assert sum(r.page_id == 8 and r.record_type == "response" for r in rows) == 2
    assert by[7].payload_bytes == 400_000
    for r in pages.collect():
        assert by[r.page_id].payload_digest == base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode()


def test_small_payloads_stay(pages):
    assert {r.page_id for r in warc.archive(pages, min_bytes=12).collect() if r.record_type == "revisit"} == set()


def test_empty(pages):
    assert warc.archive(pages.limit(0)).count() == 0


def test_damage_is_found():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_files_are_rolled_by_bytes(spark):
    """Classes of size, each with its number of records in a file; what is read back is the same."""
    rows = [(i, f"http://h/{i}", f"{i} " + "x" * n) for i, n in enumerate([10] * 30 + [900] * 12 + [40_000] * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "rolled")
    warc.write_archives(df, path, file_bytes=4000, classes=(100, 1000))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", "length").collect()
    counts = {c: sum(f"class-{c}/" in f.path for f in files) for c in range(3)}
    assert counts == {0: 1, 1: 3, 2: 3}, counts
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
    assert got == {i: t for i, _, t in rows}
