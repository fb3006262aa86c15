from __future__ import annotations

import glob
import gzip
import hashlib
from base64 import b32encode

import pytest

from cases import rows_of
from sessionmeter.llm import warc
from sessionmeter.session import work_path


def digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = "page_id long, url string, html string, digest string, record_type string, value string"


def test_page_archive_odd_rows(spark):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\n\n\r"
    pages = [
        (1, "u", None), (2, None, ""), (3, "u\r\nX: y", "same"), (4, "u", "same"), (4, "u", "same"), (5, "u", tricky), (None, "u", "same"), (None, "u", "alone"),
        (6, "u", "é" * 700_000), (7, "u", "x" * warc.CHUNK), (8, "u", "y" * (2 * warc.CHUNK)), (9, "u", "\n\n"),
    ]
    df = spark.createDataFrame([(*p, "a", "b", "c") for p in pages], PAGES)
    got = rows_of(warc.page_archive(df))
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = max((j for j, _, h in pages if (h or "") == (html or "") and j is not None), default=None)
        refers = first if first is not None and first != i else None
        want.append((i, len(data), digest(data), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=repr)
    empty = spark.createDataFrame([], PAGES)
    assert warc.page_archive(empty).count() == 0


def test_round_trip_of_bytes_and_chunks(spark):
    payloads = {1: bytes(range(256)) * 3000, 2: b"", 3: b"\r\n" * 5, 4: b"\xff\xfe\n\r"}
    df = spark.createDataFrame([(i, f"http://h/{i}", bytearray(p)) for i, p in payloads.items()], "record_id long, uri string, payload binary")
    path = work_path(spark, "round-trip")
    warc.write_archives(df, path)
    chunks = warc.read_chunks(spark, path).collect()
    for i, p in payloads.items():
        own = sorted((c for c in chunks if c.record_id == str(i)), key=lambda c: c.chunk)
        assert b"".join(bytes(c.data) for c in own) == p
        assert [c.chunk for c in own] == list(range(len(own))) and max(len(c.data) for c in own) <= warc.CHUNK
        assert [c.is_last for c in own] == [False] * (len(own) - 1) + [True]
        for c in own:
            assert c.digest_so_far == digest(p[: c.offset + len(c.data)])
    assert warc.record_table(warc.read_chunks(spark, path)).where("not digest_agrees").count() == 0


def test_archives_follow_the_format(spark):
    df = spark.createDataFrame([(1, "http://h/1", "a" * 10), (2, "http://h/2", "b" * (warc.CHUNK + 5))], "record_id long, uri string, payload string")
    path = work_path(spark, "format")
    warc.write_archives(df, path)
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{path.removeprefix('file:')}/*.gz")))
    kinds = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        kinds.append((fields["WARC-Type"], fields.get("WARC-Segment-Number"), fields.get("WARC-Segment-Total-Length")))
        raw = rest[n + 4 :]
    assert sorted(kinds, key=repr) == sorted([("response", None, None), ("response", "1", None), ("continuation", "2", str(warc.CHUNK + 5))], key=repr)


def test_smallest_keeps_short_payloads_as_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "record_id long, uri string, payload string")
    got = {r.record_id: r.refers_to for r in warc.planned(df, smallest=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


@pytest.mark.parametrize("cut", [6, 60, 400])
def test_truncated_file_has_no_last_chunk(cut):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\nContent-Length: 500\r\n\r\n" + b"z" * 500 + b"\r\n\r\n"
    whole = list(warc.Reader().lines(iter(record.split(b"\n"))))
    assert whole[-1]["is_last"] and whole[-1]["data"] == b"z" * 500
    assert not any(c["is_last"] for c in warc.Reader().lines(iter(record[:-cut].split(b"\n"))))
