"""Operator 3: round trip, revisits, random access."""

import hashlib
from collections import defaultdict

import pytest

from epiframe.llm import warc


def brute(rows):
    best = defaultdict(list)
    for p, _, h in rows:
        best[(h or "").encode()].append(p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        top = max((x for x in best[b] if x is not None), default=None)
        revisit = len(b) >= 1000 and len(best[b]) > 1 and p != top
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r[:5]) for r in warc.archive(df).collect()), key=str)


@pytest.mark.parametrize("frame", [1 << 20, 3000])
def test_pages(spark, sf, monkeypatch, frame):
    monkeypatch.setattr(warc, "FRAME_BYTES", frame)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    long = "é\r\n\r\nx" * 200
    rows += [(9001, None, None), (9002, "a b\r\né", ""), (9003, "u", long), (9004, "u", long), (9004, "u", long), (None, "u", long), (9005, "u", "x" * 999), (9006, "u", "x" * 999), (9007, "", "WARC/1.1\r\n\r\n" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert run(df) == brute(rows)


def test_payload_of_many_pages(spark, monkeypatch):
    """A third of all pages hold one payload; joined by broadcast, and by shuffle where that is too large."""
    hot = "<p>same é</p>" * 100
    rows = [(k, f"http://h/{k}", hot if k % 3 == 0 else f"<p>{k}</p>" * 200) for k in range(900)]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "page_id long, url string, html string, digest string, key string, shared int").repartition(5)
    assert run(df) == brute(rows)
    monkeypatch.setattr(warc, "small_side", lambda df: df)
    assert run(df) == brute(rows)


def test_as_many_read_tasks_as_bundles(spark, sf, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.read.parquet(f"{sf}/pages.parquet").repartition(6), path)
    assert warc.read_warc(spark, path).rdd.getNumPartitions() == spark.read.parquet(f"{path}/index").select("path").distinct().count() == 6


def test_empty(spark):
    assert run(spark.createDataFrame([], "page_id long, url string, html string")) == []


def test_random_access(spark, sf, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_warc(pages, path)
    html = {r.page_id: r.html for r in pages.collect()}
    for r in spark.read.parquet(f"{path}/index").collect():
        found = warc.Bundle(r.path).record(r.frame, r.offset)
        assert found["page_id"] == r.page_id
        if found["record_type"] == "response":
            assert found["payload"].decode() == html[r.page_id]


@pytest.mark.parametrize("bundles", [1, 8, 32])
def test_one_bundle_a_task(spark, tmp_path, bundles):
    path = f"file://{tmp_path}/w"
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat('x', 20) AS html")
    warc.write_warc(pages.repartition(bundles), path)
    sizes = [len(p) for p in warc.read_warc(spark, path).rdd.glom().collect()]
    assert len(sizes) == bundles and min(sizes) > 0 and sum(sizes) == 400


def test_urls_come_back_as_they_are(spark):
    urls = ["http://a/b", "http://a/b c", "http://a/%20b é", "ü\r\nWARC-Type: x", "", None, "http://a/%zz|\\^`{}<>\"", "a" * 100_000]
    df = spark.createDataFrame([(k, u, f"<p>{k}</p>") for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert [r.target_uri for r in warc.archive(df).orderBy("page_id").collect()] == urls


def test_very_long_payloads(spark):
    rows = [(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), (3, None, "x" * 2_500_000), (4, "u", "")]
    assert run(spark.createDataFrame(rows, "page_id long, url string, html string")) == brute(rows)
