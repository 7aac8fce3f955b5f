import hashlib

import pytest
import zstandard

from gridloom.llm import warc
from gridloom.llm.shared import scratch

HTML = "<p>" + "x" * 120 + "</p>"


def written(spark, rows, schema="page_id long, url string, html string, digest int"):
    index = warc.write_bundles(spark.createDataFrame(rows, schema).repartition(3), scratch(spark, "w"))
    return index, warc.read_bundles(index)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 500)
    rows = [(i, f"http://a/{i}", f"<i>{i}</i>" * (i * 7 % 90), 0) for i in range(150)]
    rows += [(500 + i, "http://copy", HTML, 0) for i in range(40)] + [(900, None, None, 0), (901, "bad\r\nurl: x", "\r\n\r\nWARC/1.1\r\n\r\n", 0), (902, "u", "é😀" * 60, 0), (903, "u", "s", 0), (904, "u", "s", 0)]
    index, got = written(spark, rows)
    by = {r.page_id: r for r in got.collect()}
    assert len(by) == len(rows) and index.select("uri").distinct().count() > 3
    for p, _, html, _ in rows:
        data, r = (html or "").encode(), by[p]
        first = min(q for q, _, h, _ in rows if (h or "") == (html or ""))
        copy = len(data) >= 100 and first != p
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if copy else ("response", None))


def test_bundles_are_zstandard_with_a_seek_table(spark):
    index, _ = written(spark, [(1, "u", HTML, 0), (2, "u", "y", 0)])
    row = index.first()
    path = row.uri.removeprefix("file://")
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == index.where(index.uri == row.uri).count()
    b = warc.opened(row.uri)
    headers, payload, _ = warc.parsed(b.frame(row.frame), row.place)
    assert headers["WARC-Record-ID"] == f"<urn:page:{row.page_id}>" and payload in (HTML.encode(), b"y")


def test_nulls_repeats_and_no_rows(spark):
    _, got = written(spark, [(None, None, HTML, 0), (7, "u", HTML, 0), (7, "u", HTML, 0), (8, "u", HTML, 0)])
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got.collect()) == [("7", "response", None), ("7", "response", None), ("8", "revisit", 7), ("None", "revisit", 7)]
    index = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "w"))
    assert warc.read_bundles(index).count() == 0


def test_no_seek_table():
    with pytest.raises(ValueError):
        warc.Bundle(lambda a, n: b"\0" * n, 100)
