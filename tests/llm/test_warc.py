"""WARC round trip, revisit rules, gzip members and the sidecar index."""

from __future__ import annotations

import glob
import gzip
import hashlib
import io
import json

from conftest import SF
from oracles import assert_same

from corpusloom.llm import warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query(spark, duck):
    assert_same(warc.op10_warc(spark, SF), duck(SF), warc.ORACLE)


def test_edges(spark, tmp_path):
    long, other = "ä" * 80, "y" * 100
    rows = [(5, "u5", long, "z"), (3, "u\r\n3", long, "z"), (9, None, long, "z"), (4, "u4", None, "z"), (6, "u6", "", "z"), (7, "u7", "short", "z"), (8, "u8", "short", "z"), (2, "u2", other, "z"), (2, "u2", other, "z"), (None, "un", other, "z"), (11, "u11", "WARC/1.1\r\n\r\n" * 20, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    normal, folder = warc.archived(pages)
    back = warc.read_archives(normal, folder).collect()
    assert len(back) == len(rows)
    by = {}
    for r in back:
        by.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in by[3]] == ["response"] and by[3][0]["html"] == long and by[3][0]["url"] == "u%0D%0A3"
    for i in (5, 9):
        assert (by[i][0]["record_type"], by[i][0]["refers_to"], by[i][0]["payload_bytes"]) == ("revisit", 3, 160)
    assert all(by[i][0]["record_type"] == "response" for i in (4, 6, 7, 8, 11))
    assert sorted(r["record_type"] for r in by[2]) == ["response", "revisit"]
    assert by[None][0]["refers_to"] == 2
    assert by[11][0]["html"] == rows[-1][2]
    assert all(r["payload_digest"] == hashlib.sha256((r["html"] or "").encode()).hexdigest() for r in back if r["record_type"] == "response")
    empty, where = warc.archived(pages.limit(0))
    assert warc.read_archives(empty, where).count() == 0


def test_members(spark):
    """Each index line names a gzip member that holds one whole record; the members make up the file."""
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * (i * 30)) for i in range(40)], "page_id long, url string, html string")
    normal, _ = warc.archived(pages)
    n = 0
    for r in normal.collect():
        data = open(r["path"].removeprefix("file:"), "rb").read()
        at = 0
        for line in open(r["index_path"].removeprefix("file:")):
            offset, length, _, kind = json.loads(line)
            assert offset == at and kind == "response"
            one = gzip.GzipFile(fileobj=io.BytesIO(data[offset : offset + length])).read()
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
            at += length
            n += 1
        assert at == len(data)
    assert n == 40
    assert not glob.glob("*.part")


def test_inflates_many_members():
    data = gzip.compress(b"a" * 3_000_000) + gzip.compress(b"b" * 10)
    assert b"".join(warc.inflated(io.BytesIO(data))) == b"a" * 3_000_000 + b"b" * 10
