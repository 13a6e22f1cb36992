"""WARC: records written and read back, transactions, and payloads made to confuse a reader."""

import hashlib

from custodia.llm import warc
from custodia.llm.common import scratch_path

NASTY = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "é" * 60


def run(spark, rows):
    path = scratch_path(spark, "warc-test")
    warc.write_captures(spark.createDataFrame(rows, "page_id long, url string, html string, extra int"), path)
    records = warc.read_records(spark, path)
    return records, warc.transactions(records)


def test_transactions(spark):
    big = "same " * 40
    rows = [(3, "http://c/", big, 1), (1, "http://a/", big, 1), (2, "http://b/\r\nX: y", NASTY, 1), (4, None, None, 1), (5, "", "short", 1), (6, "http://f/", "short", 1), (7, "http://g/", NASTY, 1)]
    records, captures = run(spark, rows)
    assert records.count() == 3 * len(rows)
    out = {int(warc_id): r for r in captures.withColumn("id", warc.field(captures.metadata, "page-id")).collect() if (warc_id := r.id) is not None}
    assert {k: r.record_type for k, r in out.items()} == {1: "response", 3: "revisit", 2: "response", 7: "revisit", 4: "response", 5: "response", 6: "response"}
    for i, url, html, _ in rows:
        r, data = out[i], (html or "").encode()
        assert r.request is not None and r.metadata is not None and r.request.http_header.startswith("GET ")
        assert r.response.payload_digest == "sha256:" + hashlib.sha256(data).hexdigest()
        assert f"Content-Length: {len(data)}" in r.response.http_header
        assert bytes(r.response.payload) == (b"" if r.record_type == "revisit" else data)
        assert r.target_uri == (url or "").replace("\r", "%0D").replace("\n", "%0A")
    assert "page-id: 1\r" in out[3].origin.fields and "page-id: 2\r" in out[7].origin.fields and out[1].origin is None


def test_repeated_null_and_empty(spark):
    big = "z" * 200
    _, captures = run(spark, [(1, "u", big, 1), (1, "u", big, 1), (None, "v", big, 1), (2, "w", big, 1)])
    rows = captures.withColumn("id", warc.field(captures.metadata, "page-id")).collect()
    assert sorted((str(r.id), r.record_type) for r in rows) == [("1", "response"), ("1", "response"), ("2", "revisit"), ("None", "revisit")]
    assert all("page-id: 1\r" in r.origin.fields for r in rows if r.record_type == "revisit")
    records, captures = run(spark, [])
    assert records.count() == 0 and captures.count() == 0
    _, captures = run(spark, [(None, "u", big, 1), (None, "u", big, 1)])
    assert [r.record_type for r in captures.collect()] == ["response", "response"]


def test_records_without_partners(spark):
    records, _ = run(spark, [(1, "u", "a" * 120, 1)])
    lone = warc.transactions(records.where("record_type = 'response'")).collect()
    assert len(lone) == 1 and lone[0].request is None and lone[0].metadata is None
    assert warc.transactions(records.where("record_type <> 'response'")).count() == 0


def test_parser_reads_gzip_members_and_refuses_cut_files():
    import gzip

    import pytest
    one = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bytes(b) for _, b in warc.parse(warc.archive(gzip.compress(one) + gzip.compress(one)))] == [b"abc", b"abc"]
    assert list(warc.parse(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse(one[:-6]))
