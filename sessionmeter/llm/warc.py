"""WARC archives written and read as chunk rows.

Writing. Each record of a table (record_id, uri, payload) becomes a WARC record. Of records with equal payloads of
at least `smallest` bytes, that with the largest id is written as response; the others revisit it and carry no
payload. A payload longer than `CHUNK` bytes is written in segments (a response, then continuation records), a row per
segment, so that neither a row nor a task ever holds a record's bytes twice. Archives are gzip files made by Spark's
text writer: a row is a record's head and block, and the line end after it closes the record.

Reading. Archives are read as lines by Spark's text reader, in order within a file, and a running parser cuts the
blocks by their stated length. It gives a row per chunk of at most `CHUNK` bytes: record, chunk number, offset, bytes,
the SHA-1 of the payload so far, and whether the chunk is the last one. Only the chunk at hand is kept.

Null and empty payloads are records of zero bytes (one chunk, number 0). Null ids are kept; they are the least. Rows with
the same id and payload as the response are responses too. Line breaks in ids and URIs become blanks. A file that ends
within a record gives the chunks read so far, none of them the last (one byte short, only its digest tells). Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.llm.base import ready
from sessionmeter.session import work_path

CHUNK = 1 << 18
SALTS = 8
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# RFC 4648 base32, and the digits that conv() writes for base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Bare base32 of the SHA-1: 5 hexadecimal digits make 4 of base 32."""
    hexadecimal = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def planned(records: DataFrame, smallest: int = 0) -> DataFrame:
    """Each record with payload_bytes, digest and refers_to (null for a response)."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = records.select("record_id", "uri", payload.alias("payload")).withColumns(
        {"payload_bytes": F.length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))}
    )
    shared = (
        rows.where(F.col("payload_bytes") >= smallest).groupBy("digest", "payload_bytes")
        .agg(F.max("record_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        # a page copied to a third of all rows must not meet in one task
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("_n")
    )
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("record_id", "uri"), F.lit(SALTS)).cast("int"))
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(shared, ["digest", "payload_bytes", "_salt"], "left").select(
        "record_id", "uri", "payload", "payload_bytes", "digest", refers.alias("refers_to")
    )


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(_one_line(record_id.cast("string")), F.lit("")), F.lit(">"))


def _one_line(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def write_archives(records: DataFrame, path: str, smallest: int = 0) -> None:
    """Write (record_id, uri, payload) as gzip WARC files below `path`."""
    rows = planned(records, smallest)
    revisit = F.col("refers_to").isNotNull()
    parts = F.when(revisit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / CHUNK))).cast("int")
    rows = rows.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    block = F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", (F.col("_part") - 1) * CHUNK + 1, F.lit(CHUNK)))
    first, segmented = F.col("_part") == 1, F.col("_parts") > 1

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    nothing = F.lit("")
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    own_id = F.when(first, _urn(F.col("record_id"))).otherwise(
        F.concat(F.regexp_replace(_urn(F.col("record_id")), ">$", ""), F.lit("#"), F.col("_part").cast("string"), F.lit(">"))
    )
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", own_id),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("uri").isNotNull(), line("WARC-Target-URI", _one_line(F.col("uri")))).otherwise(nothing),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))).otherwise(nothing),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"))),
            line("WARC-Refers-To-Payload-Length", F.col("payload_bytes").cast("string")),
        )).otherwise(nothing),
        F.when(segmented, line("WARC-Segment-Number", F.col("_part").cast("string"))).otherwise(nothing),
        F.when(segmented & ~first, line("WARC-Segment-Origin-ID", _urn(F.col("record_id")))).otherwise(nothing),
        F.when(segmented & (F.col("_part") == F.col("_parts")), line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"))).otherwise(nothing),
        F.when(first & ~revisit, line("Content-Type", F.lit("text/html; charset=utf-8"))).otherwise(nothing),
        line("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n"),
    )
    # the writer ends a row with one line break; a record ends with two
    whole = F.concat(head.cast("binary"), block, F.lit(b"\r\n"))
    rows.select(whole.cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class Reader:
    """Cuts records out of lines; keeps the chunk at hand and the digest so far."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.head: dict[str, str] | None = None
        self.left = 0
        self.buffer = bytearray()

    def lines(self, lines: Iterator[bytes]) -> Iterator[dict]:
        """Chunk rows of one file's lines, given without their line feed."""
        record: dict = {}
        for raw in lines:
            raw = raw + b"\n"
            while raw:
                if self.left:
                    took = raw[: self.left]
                    raw, self.left = raw[len(took) :], self.left - len(took)
                    self.buffer += took
                    while len(self.buffer) >= CHUNK:
                        # a full chunk that ends the record waits for its end mark below
                        if len(self.buffer) == CHUNK and not self.left:
                            break
                        yield self._chunk(record, bytes(self.buffer[:CHUNK]), False)
                        del self.buffer[:CHUNK]
                    if not self.left:
                        yield from self._end(record)
                    continue
                text = raw.rstrip(b"\r\n").decode("utf-8", "replace")
                raw = b""
                if text.startswith("WARC/"):
                    self.head = {}
                elif self.head is not None and text:
                    name, _, value = text.partition(":")
                    self.head[name.strip().lower()] = value.strip()
                elif self.head is not None:
                    record = self._begin(record)
                    if not self.left:
                        yield from self._end(record)

    def _begin(self, before: dict) -> dict:
        head, self.left = self.head, int(self.head.get("content-length", 0))
        kind = head.get("warc-type", "")
        if kind == "continuation" and before.get("record") == head.get("warc-segment-origin-id"):
            before["segment_last"] = "warc-segment-total-length" in head
            return before
        return {
            "record": head.get("warc-record-id", ""), "type": kind, "uri": head.get("warc-target-uri"), "head": head,
            "chunk": 0, "offset": 0, "sha1": hashlib.sha1(), "segment_last": "warc-segment-number" not in head,
        }

    def _end(self, record: dict) -> Iterator[dict]:
        data = bytes(self.buffer)
        self._reset()
        if data or record["segment_last"]:
            yield self._chunk(record, data, record["segment_last"])

    def _chunk(self, record: dict, data: bytes, last: bool) -> dict:
        record["sha1"].update(data)
        head = record["head"]
        row = {
            "record_id": _plain(record["record"]), "record_type": record["type"], "uri": record["uri"], "chunk": record["chunk"],
            "offset": record["offset"], "data": data, "digest_so_far": b32encode(record["sha1"].digest()).decode(), "is_last": last,
            "stated_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": _plain(head["warc-refers-to"]) if "warc-refers-to" in head else None,
            "refers_to_bytes": int(head["warc-refers-to-payload-length"]) if "warc-refers-to-payload-length" in head else None,
        }
        record["chunk"] += 1
        record["offset"] += len(data)
        return row


def _plain(urn: str) -> str:
    return urn.removeprefix("<").removesuffix(">").removeprefix("urn:record:")


CHUNK_ROW = (
    "record_id string, record_type string, uri string, chunk long, offset long, data binary, digest_so_far string, is_last boolean, "
    "stated_digest string, refers_to string, refers_to_bytes long"
)
NAMES = [x.split()[0] for x in CHUNK_ROW.split(", ")]


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives below `path`; without data, bytes are counted and digested but not kept."""
    lines = ready(spark).read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple[str, bytes]]:
            for part in batches:
                yield from zip(part["file"], part["value"])

        def chunks() -> Iterator[dict]:
            at = rows()
            pending = next(at, None)
            while pending is not None:
                file = pending[0]

                def one_file() -> Iterator[bytes]:
                    nonlocal pending
                    while pending is not None and pending[0] == file:
                        yield pending[1]
                        pending = next(at, None)

                yield from Reader().lines(one_file())

        out, size = [], 0
        for row in chunks():
            row["n_bytes"] = len(row["data"])
            if not with_data:
                row["data"] = None
            out.append(row)
            size += len(row["data"] or b"") + 200
            if size > 8_000_000:
                yield pd.DataFrame(out, columns=[*NAMES, "n_bytes"])
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=[*NAMES, "n_bytes"])

    return lines.mapInPandas(parse, CHUNK_ROW + ", n_bytes long")


def record_table(chunks: DataFrame) -> DataFrame:
    """A row per whole record: its length and digest, for a revisit those of the payload it refers to."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("is_last").select(
        "record_id", "record_type", "uri",
        F.when(revisit, F.col("refers_to_bytes")).otherwise(F.col("offset") + F.col("n_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "refers_to",
        F.when(~revisit, F.col("stated_digest") == F.col("digest_so_far")).alias("digest_agrees"),
    )


def page_archive(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: a row per page."""
    path = work_path(pages.sparkSession, "warc")
    html = F.col("html").cast("string").cast("binary")
    write_archives(pages.select(F.col("page_id").alias("record_id"), F.col("url").cast("string").alias("uri"), html.alias("payload")), path)
    rows = record_table(read_chunks(pages.sparkSession, path, with_data=False))
    return rows.select(
        F.nullif(F.col("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.nullif(F.col("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )
