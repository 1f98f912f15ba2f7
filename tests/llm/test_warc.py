from __future__ import annotations

import base64
import hashlib
import os

import pytest
import zstandard

from attestra.llm import warc

ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://é/", ""), (5, "http://c/", "é" * 1000),
    (9, "http://d/", "<p>one</p>"), (6, "http://e/", "x" * 300000), (7, "u", "a\r\n\r\nb"), (7, "u", "a\r\n\r\nb"), (-8, "u", "n"), (None, "u", "n"),
    (None, "v", "only"), (10, "w", "z"),
]


def brute(rows, smallest=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "").encode() == data and j is not None]
        top = max(same, default=None) if len(data) >= smallest else i
        revisit = len(data) >= smallest and top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("smallest", [0, 5])
def test_round_trip(spark, tmp_path, monkeypatch, smallest):
    manifest = warc.write(pages(spark), str(tmp_path / "w"), smallest=smallest)
    records = warc.read(spark, manifest)
    assert sorted(map(tuple, warc.payload_report(records).collect()), key=repr) == brute(ROWS, smallest)
    assert sum(r.records for r in manifest.collect()) == len(ROWS)
    assert all(r.problem is None for r in records.collect())


def test_many_archives_with_dictionaries(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", f"<html><head><title>{i}</title></head>" + f"<p>{i * i} word</p>" * 60) for i in range(400)]
    records = [warc._record(i, u, h.encode(), hashlib.sha1(h.encode()).hexdigest().encode(), None) for i, u, h in rows]
    data = warc.archive(records, [h.encode() for _, _, h in rows])
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.records_of(data)) == records
    folder = tmp_path / "one.warc.zst"
    folder.write_bytes(data)
    assert len(warc.read(spark, paths=[str(folder)]).collect()) == 400
    got = warc.payload_report(warc.read(spark, warc.write(pages(spark, rows), f"file://{tmp_path}/more"))).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert os.listdir(tmp_path / "more")


def test_compressed_dictionary(spark):
    payloads = [f"<html><p>{i * i} word word</p>".encode() * 20 for i in range(200)]
    trained = zstandard.train_dictionary(4096, payloads)
    packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
    frames = b"".join(zstandard.ZstdCompressor(dict_data=trained).compress(p) for p in payloads)
    assert list(warc.records_of(b"\x5d\x2a\x4d\x18" + len(packed).to_bytes(4, "little") + packed + frames)) == payloads


@pytest.mark.parametrize("change, problem", [
    (lambda r: r.replace(b"\r\nContent-Length: 81", b"\r\nContent-Length: 80"), "length differs"),
    (lambda r: r.replace(b"WARC/1.1", b"HTML/1.1"), "no WARC header"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "no warc-date"),
    (lambda r: r.replace(b"<p>", b"<q>"), "digest differs"),
    (lambda r: r.replace(b"WARC-Type:", b"WARC-Type"), "without a colon"),
    (lambda r: r[:-1], "length differs"),
])
def test_broken_records_are_named(change, problem):
    record = warc._record(1, "http://a/", b"<p>", hashlib.sha1(b"<p>").hexdigest().encode(), None)
    assert warc.parse(record)["problem"] is None
    assert problem in warc.parse(change(record))["problem"]


def test_broken_archives_are_named_and_stop_the_report(spark, tmp_path):
    record = warc._record(1, "http://a/", b"<p>", hashlib.sha1(b"<p>").hexdigest().encode(), None)
    data = warc.archive([record, record], [])
    for name, content in (("cut", data[:-5]), ("junk", data + b"12345678"), ("fine", data)):
        (tmp_path / name).write_bytes(content)
    found = warc.read(spark, paths=[str(tmp_path / n) for n in ("cut", "junk", "fine")])
    problems = {(os.path.basename(r.path), r.problem is None) for r in found.collect()}
    assert problems == {("cut", True), ("cut", False), ("junk", True), ("junk", False), ("fine", True)}
    with pytest.raises(Exception, match="cut-off|no frame"):
        warc.payload_report(found).collect()


def test_empty(spark, tmp_path):
    manifest = warc.write(pages(spark).limit(0), str(tmp_path))
    assert warc.payload_report(warc.read(spark, manifest)).collect() == []
