"""Archives: exact round trip, revisits, ranges."""

from __future__ import annotations

import hashlib

from tidemark.llm import warc
from tidemark.llm.common import shared_dir

PAGES = [
    (5, "http://a/1", "x" * 200), (3, "http://a/2", "x" * 200), (9, None, "x" * 200), (1, "http://b\r\nEvil: 1", "short"), (2, "http://b/2", "short"), (4, "u", None), (6, "u", ""),
    (7, "ü\nv", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é日" * 500), (8, "u", "y" * 3_000_000), (10, "u", "\r\n" * 80), (None, "u", "x" * 200), (3, "http://a/2", "x" * 200),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, offset string")
    for parts in (1, 4):
        index = warc.archive_pages(pages.repartition(parts), shared_dir(spark))
        rows = warc.read_records(index).collect()
        assert len(rows) == len(PAGES)
        texts = {p: (h or "").encode() for p, _, h in PAGES}
        seen = {}
        for r in rows:
            page = int(r.record_id.rsplit(":", 1)[1].rstrip(">") or -1)
            want = texts[page if page >= 0 else None]
            assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())
            assert r.record_type == "revisit" or bytes(r.payload) == want
            seen.setdefault(page, set()).add((r.record_type, r.refers_to and r.refers_to.rsplit(":", 1)[1].rstrip(">")))
        assert seen[3] == {("response", None)} and seen[5] == seen[9] == seen[-1] == {("revisit", "3")}
        assert seen[1] == seen[2] == seen[4] == seen[6] == {("response", None)}


def test_selected_records_only(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"page {k} " * 50) for k in range(200)], "page_id long, url string, html string")
    index = warc.archive_pages(pages.repartition(3), shared_dir(spark))
    rows = warc.read_records(index.where("url in ('http://h/7', 'http://h/8', 'http://h/150')")).collect()
    assert sorted(bytes(r.payload).decode().split()[1] for r in rows) == ["150", "7", "8"]


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), shared_dir(spark)).count() == 0
