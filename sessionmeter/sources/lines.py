"""Log files as ordered lines.

Every reader returns: path, file_mtime (epoch s), file_size, ord, value. `ord` is one BIGINT that sorts
the lines of a file in file order even when the file was read in many splits: the split's start (in 64
KiB steps) in the high bits, the row number inside the task in the low 33 bits. It is fixed at the scan,
before any shuffle, and the same again when a lost task is read anew. Splits must be 64 KiB or larger: a session that is
set to smaller ones is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.sources.files import Layout, Places, find_files

LINE_SCHEMA = "path string, file_mtime bigint, file_size bigint, ord bigint, value string"
LINE_BITS = 33
START_STEP_BITS = 16


def line_order() -> Column:
    start = F.shiftright(F.col("_metadata.file_block_start"), START_STEP_BITS)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    return F.shiftleft(start, LINE_BITS) + row


def _read(spark: SparkSession, paths: list[str], since: int | None, **options: str) -> DataFrame:
    """`since` (epoch s) drops files not changed since then while listing, before any is opened."""
    try:
        raw = spark.read.options(**options).text(paths)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LINE_SCHEMA)
    if since is not None:
        raw = raw.where(F.col("_metadata.file_modification_time") >= F.timestamp_seconds(F.lit(since)))
    return _ordered_lines(raw)


def _ordered_lines(raw: DataFrame) -> DataFrame:
    conf = raw.sparkSession._jsparkSession.sessionState().conf()
    if min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()) < 1 << START_STEP_BITS:
        raise ValueError("spark.sql.files.maxPartitionBytes and openCostInBytes must be 64 KiB or more")
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.unix_seconds(F.col("_metadata.file_modification_time")).alias("file_mtime"),
        F.col("_metadata.file_size").alias("file_size"),
        line_order().alias("ord"),
        "value",
    )


def claude_lines(spark: SparkSession, root: str, compressed: bool = False, since: int | None = None) -> DataFrame:
    """`<root>/<project>/<session>.jsonl`, exactly two levels down."""
    names = "{*.jsonl,*.jsonl.gz}" if compressed else "*.jsonl"
    return _read(spark, [f"{root}/*/{names}"], since)


def claude_subagent_lines(spark: SparkSession, root: str, compressed: bool = False) -> DataFrame:
    """`<root>/<project>/<parent>/subagents/agent-*.jsonl`, with the parent session."""
    names = "{agent-*.jsonl,agent-*.jsonl.gz}" if compressed else "agent-*.jsonl"
    lines = _read(spark, [f"{root}/*/*/subagents/{names}"], None)
    return lines.withColumn("parent_session_id", F.regexp_extract("path", r"([^/]+)/subagents/[^/]+$", 1))


# Options of the reader, and its path below the root, of each agent's logs.
CODEX_OPTIONS = {"recursiveFileLookup": "true", "pathGlobFilter": "rollout-*.jsonl"}
LAYOUTS = {"claude": ("/*/*.jsonl", {}), "codex": ("", CODEX_OPTIONS), "qwen": ("/*/chats/*.jsonl", {})}


def is_codex_log(root: str) -> Column:
    """At most five levels down, with an id in its name; paths are absolute URIs, so the last part of the root counts."""
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return (F.size(F.split(below, "/")) <= 5) & codex_raw_id(F.col("path")).isNotNull()


def codex_lines(spark: SparkSession, root: str, since: int | None = None) -> DataFrame:
    """`rollout-*.jsonl` at most five levels down; a dated root reads those days only."""
    return _read(spark, [root], since, **CODEX_OPTIONS).where(is_codex_log(root))


def qwen_lines(spark: SparkSession, root: str, since: int | None = None) -> DataFrame:
    """`<root>/<project>/chats/<session>.jsonl`."""
    return _read(spark, [f"{root}/*/chats/*.jsonl"], since)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)\.jsonl(\.gz)?$", 1)


def codex_raw_id(path: Column) -> Column:
    """The id behind `rollout-<19 characters of time>-`; NULL for shorter names."""
    body = F.regexp_extract(path, r"rollout-([^/]*)\.jsonl$", 1)
    return F.when(F.length(body) >= 20, F.substr(body, F.lit(21)))


def session_id(agent: str, path: Column) -> Column:
    if agent == "claude":
        return stem(path)
    if agent == "codex":
        return F.concat(F.lit("codex:"), codex_raw_id(path))
    return F.concat(F.lit(f"{agent}:"), stem(path))


FILE_SCHEMA = "path string, file_mtime bigint, file_size bigint"

# Which files below a root are logs, as paths from there. Names with a dot or underscore in front are hidden.
_LOG = r"[^/._][^/]*\.jsonl"
_SUBAGENT = r"[^/]+/[^/]+/subagents/agent-[^/]*\.jsonl"
PLACES = {
    "claude": Layout(files=f"[^/]+/{_LOG}", folders="[^/]+"),
    "claude wide": Layout(
        files=rf"(?:[^/]+/{_LOG}|{_SUBAGENT})(?:\.gz)?", folders="[^/]+|[^/]+/[^/]+|[^/]+/[^/]+/subagents",
    ),
    "codex": Layout(files=r"(?:[^/]+/){0,4}rollout-[^/]{20,}\.jsonl", folders=r"[^/]+(?:/[^/]+){0,3}"),
    "qwen": Layout(files=f"[^/]+/chats/{_LOG}", folders="[^/]+|[^/]+/chats"),
}


def list_files(spark: SparkSession, agent: str, root: str, wide: bool = False, since: str | None = None) -> DataFrame:
    """path, file_mtime, file_size of every log of one agent, listed by tasks, without reading any content.

    `wide` adds compressed logs and subagents of the claude dialect; `since` (a day) leaves out dated folders before it. A
    root that does not exist is an error: taken for an empty one, it would make every known file look gone.
    """
    layout = PLACES["claude wide" if agent == "claude" and wide else agent]
    found = find_files(spark, root, layout, since)
    return found.where(F.col("size") > 0).select("path", F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"))


# bytes of a file that one row of work stands for, a multiple of the step of `ord`
SPLIT_BYTES = 1 << 25
# bytes and lines handed over at a time, and bytes that are worth one more task
BATCH_BYTES, BATCH_LINES, TASK_BYTES = 1 << 22, 10_000, 1 << 27
_LINE_END = re.compile(b"\r\n|\n|\r")
_MARK = b"\xef\xbb\xbf"


def split_lines(file: BinaryIO, start: int, stop: int, size: int) -> list[bytes]:
    """The lines, cut as Spark's reader cuts them, that begin from byte `start` to before `stop` of a file of `size` bytes.

    A line ends with LF, CR or both. A byte order mark at the start of a file is not part of its first line.
    """
    first = max(0, start - 1)
    file.seek(first)
    data = file.read(stop - first)
    if start:
        # the end of the line before shows where the first one of this split begins
        end = _LINE_END.search(data)
        if end is None or end.end() >= len(data):
            return []
        data = data[end.end() :]
    elif data.startswith(_MARK):
        data = data[len(_MARK) :]
    tail, at = [data], stop
    while at < size and not (tail[-1].endswith((b"\n", b"\r")) or len(tail) > 1 and _LINE_END.search(tail[-1])):
        block = file.read(min(size - at, BATCH_BYTES))
        if not block:
            break
        tail.append(block)
        at += len(block)
    if len(tail) > 1:
        end = _LINE_END.search(tail[-1])
        if end is not None:
            tail[-1] = tail[-1][: end.start()]
    return b"".join(tail).splitlines()


def stream_lines(file: BinaryIO) -> Iterator[bytes]:
    """The lines of a file that can't be read from the middle."""
    rest, first = [], True
    while block := file.read(BATCH_BYTES):
        if first and block.startswith(_MARK):
            block = block[len(_MARK) :]
        first = False
        cut = block.rfind(b"\n") + 1
        if cut:
            yield from b"".join([*rest, block[:cut]]).splitlines()
            rest = []
        rest.append(block[cut:])
    yield from b"".join(rest).splitlines()


def _read_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, held, size = Places(), [], 0

    def batch() -> pa.RecordBatch:
        path, mtime, size_, ord_, value = zip(*held)
        arrays = [pa.array(path), pa.array(mtime, pa.int64()), pa.array(size_, pa.int64()), pa.array(ord_, pa.int64()), pa.array(value, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["path", "file_mtime", "file_size", "ord", "value"])

    for part in batches:
        for split in part.to_pylist():
            uri, total, start = split["path"], split["file_size"], split["start"]
            place = places.of(uri)
            if uri.endswith(".gz"):
                file = place.files.open_input_stream(place.path(uri), compression="gzip")
            else:
                file = place.files.open_input_file(place.path(uri))
            with file:
                lines = stream_lines(file) if uri.endswith(".gz") else split_lines(file, start, split["stop"], total)
                for n, line in enumerate(lines, (start >> START_STEP_BITS) << LINE_BITS):
                    held.append((uri, split["file_mtime"], total, n, line))
                    size += len(line)
                    if size >= BATCH_BYTES or len(held) >= BATCH_LINES:
                        yield batch()
                        held, size = [], 0
    if held:
        yield batch()


def read_files(spark: SparkSession, files: DataFrame, work: str) -> DataFrame:
    """The ordered lines of the named files (path, file_mtime, file_size), written below `work`.

    Tasks open the files, so neither their names nor a look at each of them pass through the driver, as they do with
    Spark's reader. A file is read as far as it was listed; one that is gone by then is an error.
    """
    last = F.when(F.col("path").endswith(".gz"), F.lit(0)).otherwise(F.greatest(F.col("file_size") - 1, F.lit(0))).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), last, F.lit(SPLIT_BYTES).cast("bigint"))
    splits = files.select("path", "file_mtime", "file_size", F.explode(starts).alias("start"))
    splits = splits.withColumn("stop", F.least(F.col("start") + SPLIT_BYTES, F.col("file_size")))
    total = files.agg(F.sum("file_size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    fields = "path string, file_mtime bigint, file_size bigint, ord bigint, value binary"
    lines = splits.repartition(tasks, "path", "start").mapInArrow(_read_splits, fields)
    lines.withColumn("value", F.col("value").cast("string")).write.parquet(work)
    return spark.read.schema(LINE_SCHEMA).parquet(work)
