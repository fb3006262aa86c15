"""Files read split by split, against the whole file and against Spark's own reader."""

from __future__ import annotations

import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionmeter.sources import files, lines


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([b"\n", b"\r", b"\r\n", b"a", b"bc", b"\xff", b""]), max_size=25).map(b"".join), st.integers(1, 9), st.integers(1, 4))
def test_any_cut_gives_the_lines_of_the_whole(data, step, block):
    before, lines.BATCH_BYTES = lines.BATCH_BYTES, block
    try:
        got = [x for s in range(0, len(data), step) for x in lines.split_lines(io.BytesIO(data), s, min(s + step, len(data)), len(data))]
        assert got == data.splitlines()
        assert list(lines.stream_lines(io.BytesIO(data))) == data.splitlines()
    finally:
        lines.BATCH_BYTES = before


def test_same_lines_as_sparks_reader_without_names_on_the_driver(spark, tmp_path, monkeypatch):
    long = b"\xef\xbb\xbffirst\r\n\n" + b"x" * 70_000 + b"\rlast \xff line\n" * 20_000
    for name, data in {"a [1]{x}.jsonl": b"1\n2", "b.jsonl": long, "c%20 .jsonl": b"\n", "d.jsonl.gz": gzip.compress(long)}.items():
        (tmp_path / name).write_bytes(data)
    found = files.find_files(spark, str(tmp_path), files.Layout(files=".*", folders="none"))
    named = found.select("path", F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"))
    want = lines._ordered_lines(spark.read.text(str(tmp_path))).where("path not like '%/.%'")
    order = lambda df: [(r.path, r.file_mtime, r.file_size, bytes(r.v)) for r in df.select("*", F.col("value").cast("binary").alias("v")).orderBy("path", "ord").collect()]
    monkeypatch.setattr(lines, "SPLIT_BYTES", 1 << 16)
    monkeypatch.setattr(type(named), "toLocalIterator", lambda *_: pytest.fail("names at the driver"))
    got = lines.read_files(spark, named, f"{tmp_path}-lines")
    assert got.dtypes == want.dtypes
    assert order(got) == order(want)
