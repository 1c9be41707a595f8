import base64
import gzip
import hashlib
import io
import random
import string

import pytest

from brindle.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_round_trip(spark):
    rows = [(i, f"http://h{i}.org/", f"<p>{i % 7}</p>" * (i % 7)) for i in range(60)] + [(100, None, None), (101, "u\r\nX: y", ""), (102, "é", "ü" * 70000)]
    for split in (16 << 20, 300):
        got = {r.page_id: r for r in warc.round_trip(pages(spark, rows), split_bytes=split).collect()}
        assert len(got) == len(rows)
        top = {}
        for i, _, h in rows:
            top[h or ""] = max(i, top.get(h or "", -1))
        for i, _, h in rows:
            raw = (h or "").encode()
            want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""])
            assert tuple(got[i])[1:] == want


def test_minimum_size(spark):
    got = {r.page_id: r.record_type for r in warc.round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


class File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_splits_own_each_record_once(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)
    records = [warc.record(i, "http://a", (b"\x1f\x8b\x08" * i) + bytes(range(256)) * i, None) for i in range(12)]
    data = b"".join(records)
    starts = [sum(map(len, records[:i])) for i in range(len(records))]
    for step in (1, 7, 50, 10_000):
        if step == 1 and len(data) > 4000:
            continue
        found = [at for s in range(0, len(data), step) for at, _, _ in warc.records_in(File(data), len(data), s, min(s + step, len(data)))]
        assert found == starts


def test_false_magic_is_passed_over():
    stray = b"\x1f\x8b\x08\x00garbage"
    other = gzip.compress(b"not a record")
    data = stray + warc.record(1, "u", b"x", None) + other + warc.record(2, "u", b"y", 1) + b"\x1f\x8b"
    got = [(h["warc-type"], b) for _, h, b in warc.records_in(File(data), len(data), 0, len(data))]
    assert got == [("response", b"x"), ("revisit", b"")]


def test_members_are_gzip():
    data = warc.record(1, "u", b"hello", None) + warc.record(2, "u", b"x", 1)
    plain = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    assert plain.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:page:1>" in plain


def test_long_urls(spark):
    rng = random.Random(1)
    url = "http://a/" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(200 << 10))
    (got,) = warc.records_in(File(data := warc.record(1, url, b"x", None)), len(data), 0, len(data))
    assert got[1]["warc-target-uri"] == url and got[2] == b"x"
    assert {r.page_id for r in warc.round_trip(pages(spark, [(1, url, "x"), (2, "u", "y"), (3, url, "x")])).collect()} == {1, 2, 3}


def test_lost_records_are_noticed(spark, monkeypatch):
    whole = warc.read
    monkeypatch.setattr(warc, "read", lambda *a, **b: whole(*a, **b).limit(1))
    with pytest.raises(RuntimeError, match="2 records were written, 1 read"):
        warc.round_trip(pages(spark, [(1, "u", "a"), (2, "u", "b")]))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_and_null_ids(spark):
    got = warc.round_trip(pages(spark, [(5, "a", "same"), (5, "b", "same"), (None, "c", "same")])).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 5), (5, "response", None), (5, "revisit", 5)]
