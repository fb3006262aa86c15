"""Files looked at from inside tasks: walking folders, facts of named files, first lines, written files.

Spark's own readers list what they read on the driver. Here folders and files are rows, so that a tree of any number
of files is walked, and a few lines of many files are read, without the driver seeing a name. Paths are URIs as
Spark prints them; their scheme must be one that `pyarrow.fs` opens (file, hdfs, s3, gs, abfs) with the credentials
of the executor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.session import work_folder

FACTS = "path string, rel string, size bigint, mtime bigint"
# characters of a path that a URI must not hold as they are
_TO_QUOTE = re.compile('[\\x00-\\x20"<>#%?\\[\\]\\\\^`{|}\\x7f]')


@dataclass(frozen=True)
class Layout:
    """Which files below a root count, and which folders may hold some; patterns match the whole relative path."""

    files: str
    folders: str

    def day_of(self, rel: str) -> str | None:
        """The part of a day that a dated folder stands for: 2026, 2026-04 or 2026-04-15."""
        parts = rel.split("/")
        if len(parts) <= 3 and all(re.fullmatch("[0-9]+", p) for p in parts):
            return "-".join([parts[0], *[p.zfill(2) for p in parts[1:]]])
        return None


def quoted(path: str) -> str:
    return _TO_QUOTE.sub(lambda m: f"%{ord(m.group()):02X}", path)


def unquoted(uri: str) -> str:
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m.group(1), 16)), uri)


class Place:
    """A file system and the paths below it, with URIs as Spark prints them."""

    def __init__(self, uri: str):
        from pyarrow import fs

        scheme, _, rest = uri.partition(":") if re.match("[a-z][a-z0-9+.-]*:", uri) else ("file", "", uri)
        scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        if scheme == "file":
            self.files, self._prefix = fs.LocalFileSystem(), "file:"
        else:
            host = rest.lstrip("/").split("/", 1)[0]
            self.files, own = fs.FileSystem.from_uri(f"{scheme}://{host}/")
            # a bucket is part of the file system's own paths, the host of a cluster is not
            self._prefix = f"{uri.partition(':')[0]}://" + ("" if own.strip("/") else host)

    def path(self, uri: str) -> str:
        rest = unquoted(uri)
        if ":" in rest.split("/", 1)[0]:
            rest = rest.partition(":")[2]
        if self._prefix == "file:":
            return "/" + rest.lstrip("/")
        own = rest.lstrip("/")
        return own if self._prefix.endswith("://") else "/" + own.partition("/")[2]

    def uri(self, path: str) -> str:
        return self._prefix + quoted(path)


class Places:
    """One place per scheme and host, made once in a task."""

    def __init__(self):
        self._known: dict[str, Place] = {}

    def of(self, uri: str) -> Place:
        key = "/".join(uri.split("/", 3)[:3]) if "://" in uri and not uri.startswith("file:") else "file"
        if key not in self._known:
            self._known[key] = Place(uri)
        return self._known[key]


def _list_level(layout: Layout, since: str | None):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        places = Places()
        for part in batches:
            for uri, rel in zip(part["path"], part["rel"]):
                place, found = places.of(uri), []
                own = place.path(uri).rstrip("/")
                for f in place.files.get_file_info(fs.FileSelector(own, allow_not_found=bool(rel))):
                    below = f"{rel}/{f.base_name}" if rel else f.base_name
                    if f.type == fs.FileType.Directory:
                        day = layout.day_of(below) if since else None
                        if re.fullmatch(layout.folders, below) and not (day is not None and day < since[: len(day)]):
                            found.append((place.uri(f.path), below, None, None))
                    elif re.fullmatch(layout.files, below):
                        found.append((place.uri(f.path), below, f.size, f.mtime_ns // 1_000_000_000))
                yield pd.DataFrame(found, columns=["path", "rel", "size", "mtime"]).astype({"size": "Int64", "mtime": "Int64"})

    return work


def find_files(spark: SparkSession, root: str, layout: Layout, since: str | None = None) -> DataFrame:
    """path, rel, size, mtime of the files below `root`, level by level, each folder listed by a task.

    `since` (a day) leaves out dated folders, <year>/<month>/<day>, that lie before it, without listing them. A root
    that does not exist is an error. The result is written below the work folder and read from there.
    """
    from sessionmeter.session import work_path

    place = Place(root)
    own = place.path(root.rstrip("/"))
    if place.files.get_file_info(own).type.name != "Directory":
        raise FileNotFoundError(f"no folder {root}")
    out = work_path(spark, "listed")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with work_folder(spark, "folders") as work:
        folders = spark.createDataFrame([(place.uri(own), "")], "path string, rel string")
        depth = 0
        while True:
            # an explicit number of tasks, as folder names are too small for Spark to see the work behind them
            spread = folders.repartition(tasks, "path") if depth else folders
            level = spread.mapInPandas(_list_level(layout, since), FACTS)
            level.withColumn("level", F.lit(depth)).write.mode("append").partitionBy("level").parquet(work)
            seen = spark.read.schema(f"{FACTS}, level int").parquet(work).where(F.col("level") == depth)
            seen.where("size is not null").drop("level").write.mode("append").parquet(out)
            folders = seen.where("size is null").select("path", "rel")
            if folders.isEmpty():
                break
            depth += 1
    return spark.read.schema(FACTS).parquet(out)


def existing(paths: DataFrame) -> DataFrame:
    """The rows of `paths` whose `path` is a file, with its size and mtime."""
    columns = [c for c in paths.columns if c != "path"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places()
        for part in batches:
            infos = [places.of(u).files.get_file_info(places.of(u).path(u)) for u in part["path"]]
            there = [i.type.name == "File" for i in infos]
            kept = part[there].copy()
            kept["size"] = pd.array([i.size for i, t in zip(infos, there) if t], "Int64")
            kept["mtime"] = pd.array([i.mtime_ns // 1_000_000_000 for i, t in zip(infos, there) if t], "Int64")
            yield kept[[*part.columns, "size", "mtime"]]

    return paths.select("path", *columns).mapInPandas(work, _reordered(fields, paths, "path") + ", size bigint, mtime bigint")


def with_text(files: DataFrame, wanted: Column) -> DataFrame:
    """Add `text`, the content of the file at `uri` where `wanted`, else NULL."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places()

        def content(uri: str) -> str:
            place = places.of(uri)
            with place.files.open_input_stream(place.path(uri)) as f:
                return f.read().decode("utf-8", "replace")

        for part in batches:
            part["text"] = pd.Series([content(u) for u in part["uri"]], dtype=object, index=part.index)
            yield part

    read = files.where(wanted).mapInPandas(work, f"{fields}, text string")
    return read.unionByName(files.where(~wanted).withColumn("text", F.lit(None).cast("string")))


def _reordered(fields: str, df: DataFrame, first: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {types[c]}" for c in [first, *[c for c in df.columns if c != first]])


def first_texts(logs: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Per key the first text at the top-level `field` of its files' JSON lines: files by `rank`, lines as they come.

    `logs`: the keys, rank, path. A file is read only as far as its first line with the field, and only if no file
    before it has one. Adds `opened`, the number of files looked at.
    """

    def strict(name: str):
        raise ValueError(name)

    def first_in(place: Place, path: str) -> str | None:
        with place.files.open_input_stream(path) as raw:
            rest = b""
            while True:
                block = raw.read(1 << 16)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                for line in lines:
                    try:
                        value = json.loads(line.decode("utf-8", "replace"), parse_constant=strict)
                    except (ValueError, RecursionError):
                        continue
                    if isinstance(value, dict) and isinstance(value.get(field), str):
                        return value[field]
                if not block:
                    return None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, last, found, opened = Places(), None, None, 0
        for part in batches:
            done = []
            for row in zip(*[part[k] for k in keys], part["path"]):
                key, uri = row[:-1], row[-1]
                if key != last:
                    if last is not None:
                        done.append((*last, found, opened))
                    last, found, opened = key, None, 0
                if found is None:
                    place = places.of(uri)
                    found, opened = first_in(place, place.path(uri)), opened + 1
            yield pd.DataFrame(done, columns=[*keys, field, "opened"])
        if last is not None:
            yield pd.DataFrame([(*last, found, opened)], columns=[*keys, field, "opened"])

    tasks = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = logs.select(*keys, "rank", "path").repartition(tasks, *keys).sortWithinPartitions(*keys, "rank")
    return ordered.mapInPandas(work, ", ".join(f"{k} string" for k in keys) + f", {field} string, opened int")


def write_lines(rows: DataFrame, root: str) -> DataFrame:
    """Write `rows` (rel, ord, value) as text files `<root>/<rel>`, lines by `ord`; returns rel and lines of each.

    A file is written by one task as the rows come, so it may be larger than memory; a repeated task writes it again.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = Place(root)
        base = place.path(root.rstrip("/"))
        last, out, lines, folders = None, None, 0, set()
        try:
            for part in batches:
                done = []
                for rel, value in zip(part["rel"], part["value"]):
                    if rel != last:
                        if out is not None:
                            out.close()
                            done.append((last, lines))
                        path = f"{base}/{rel}"
                        folder = path.rsplit("/", 1)[0]
                        if folder not in folders:
                            place.files.create_dir(folder, recursive=True)
                            folders.add(folder)
                        last, out, lines = rel, place.files.open_output_stream(path), 0
                    out.write(value.encode() + b"\n")
                    lines += 1
                yield pd.DataFrame(done, columns=["rel", "lines"]).astype({"rel": object, "lines": "int64"})
        finally:
            if out is not None:
                out.close()
        if last is not None:
            yield pd.DataFrame([(last, lines)], columns=["rel", "lines"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("rel", "ord", "value").repartition(tasks, "rel").sortWithinPartitions("rel", "ord")
    return ordered.mapInPandas(work, "rel string, lines bigint")
