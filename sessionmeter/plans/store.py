"""Canonical tables on disk, refreshed file by file.

Each table is plain Parquet, partitioned by agent and part. A file belongs to one part for good: the month in which it
was first seen, and a bucket of its path. A refresh writes the parts of new, changed and gone files again, by Spark's
dynamic partition overwrite, and leaves all others alone; logs grow for days, so these are parts of the last
months. The manifest comes last: a refresh that dies before is done again by the next one, since its files still
count as changed.

One refresh works at a time. A lock file keeps a second one waiting; one older than `STALE_SECONDS` is left over.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.operators import claude, codex, hermes, qwen
from sessionmeter.plans.manifest import READER_VERSION, changed_files, gone_files
from sessionmeter.schema import SESSION_COLUMNS, TOKEN_COLUMNS, TRANSCRIPT_COLUMNS, USAGE
from sessionmeter.session import create_new, exists, modified_seconds, remove, work_folder
from sessionmeter.sources.lines import list_files, read_files

DIALECTS = {"claude": claude, "codex": codex, "qwen": qwen}
COLUMNS = {
    "sessions": SESSION_COLUMNS, "token_events": TOKEN_COLUMNS, "transcript_events": TRANSCRIPT_COLUMNS,
}
_TYPES = dict.fromkeys(["ord", "ts", "turns", "last_active_ts", "started_at_ts", "event_index", *USAGE], "bigint") | {
    "is_scripted": "boolean", "is_user_turn": "boolean",
}
MANIFEST = "path string, file_mtime bigint, file_size bigint, version int, agent string, part string"
BUCKETS = 16
STALE_SECONDS = 86_400


def _schema(table: str) -> str:
    if table == "manifest":
        return MANIFEST
    types = _TYPES | ({"ts": "string"} if table == "transcript_events" else {})
    fields = [f"{c} {types.get(c, 'string')}" for c in COLUMNS[table] if c != "agent"]
    return ", ".join([*fields, "agent string", "part string"])


def parent_path(path: Column) -> Column:
    """The log of the session that a subagent's log belongs to; NULL for any other log."""
    found = F.regexp_extract(path, r"^(.*)/subagents/[^/]+$", 1)
    return F.when(found != "", F.concat(found, F.lit(".jsonl")))


class Store:
    def __init__(self, spark: SparkSession, root: str, wide: bool = False):
        """`wide`: also compressed logs and subagents of the claude dialect."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.wide = wide

    def _table(self, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], _schema(table))
        # a part in which no row is left holds one row without a path
        return self.spark.read.schema(_schema(table)).parquet(path).where("path is not null")

    def manifest(self) -> DataFrame:
        """The files the tables are made of."""
        return self._table("manifest")

    def read(self, table: str, since: int = 0, subagents: bool = False) -> DataFrame:
        """Current rows of `sessions`, `token_events` or `transcript_events`.

        `since` (epoch s) keeps token events from that time on; they are sorted by time, so that older row groups are not
        read. Rows of subagents are left out unless asked for; they come with `parent_path`, the log of their session.
        """
        rows = self._table(table).select(*COLUMNS[table])
        if since and table == "token_events":
            rows = rows.where(F.col("ts") >= since)
        parent = parent_path(F.col("path"))
        return rows.withColumn("parent_path", parent) if subagents else rows.where(parent.isNull())

    def refresh(
        self, roots: dict[str, str], hermes_tables: tuple[DataFrame, DataFrame] | None = None, since: str | None = None
    ) -> int:
        """Read new and changed files; returns how many. Unchanged files are not opened again.

        What is read is what one listing found: a file that appears or grows meanwhile is left to the next refresh.
        `since` (a day) lists only dated folders from that day on; files of older ones stay as they are.
        """
        with self._locked(), work_folder(self.spark, "refresh") as work:
            return self._refresh(work, roots, hermes_tables, since)

    def unlock(self) -> None:
        """Give up the lock of a refresh that is known to have died."""
        remove(self.spark, f"{self.root}/lock")

    @contextmanager
    def _locked(self, wait_seconds: int = 3_600) -> Iterator[None]:
        lock = f"{self.root}/lock"
        last = time.time() + wait_seconds
        while not create_new(self.spark, lock):
            if time.time() - modified_seconds(self.spark, lock) > STALE_SECONDS:
                remove(self.spark, lock)
            elif time.time() > last:
                raise TimeoutError(f"another refresh holds {lock}")
            else:
                time.sleep(1)
        try:
            yield
        finally:
            self.unlock()

    def _refresh(self, work: str, roots: dict[str, str], hermes_tables: tuple[DataFrame, DataFrame] | None, since: str | None) -> int:
        listed = [list_files(self.spark, a, r, self.wide, since).withColumn("agent", F.lit(a)) for a, r in roots.items()]
        if hermes_tables is not None:
            listed.append(_stored_sessions(hermes_tables[0]))
        everything = reduce(DataFrame.unionByName, listed)
        agents = [*roots, *([hermes.AGENT] if hermes_tables is not None else [])]
        known = self._kept(f"{work}/known", self.manifest().where(F.col("agent").isin(agents)))
        new = changed_files(everything, known).join(known.select("path", "part"), "path", "left")
        todo = self._kept(f"{work}/todo", new.withColumn("part", F.coalesce("part", _new_part())))
        gone = known.limit(0) if since else gone_files(everything, known)
        gone = gone.select("path", "agent", "part", F.lit(False).alias("again"))
        drop = self._kept(f"{work}/drop", todo.select("path", "agent", "part", F.lit(True).alias("again")).unionByName(gone))
        # agents times months times buckets at most
        touched = drop.groupBy("agent", "part").agg(F.count_if("again").alias("n")).collect()
        parts = [(r.agent, r.part) for r in touched]
        again = {r.agent for r in touched if r.n}
        if not parts:
            return 0
        tables = {table: [] for table in COLUMNS}
        for agent in again & DIALECTS.keys():
            paths = todo.where(F.col("agent") == agent)
            lines = read_files(self.spark, paths.select("path", "file_mtime", "file_size"), f"{work}/{agent}")
            for table, make in (("sessions", "sessions"), ("token_events", "token_events"), ("transcript_events", "transcript")):
                tables[table].append(getattr(DIALECTS[agent], make)(lines))
        if hermes.AGENT in again:
            for table, rows in self._hermes(hermes_tables, todo).items():
                tables[table].append(rows)
        for table, made in tables.items():
            fresh = [rows.join(todo.select("path", "part"), "path") for rows in made]
            self._rewrite(table, fresh, drop, parts)
        self._rewrite("manifest", [todo.withColumn("version", F.lit(READER_VERSION))], drop, parts)
        return sum(r.n for r in touched)

    def _kept(self, path: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _rewrite(self, table: str, fresh: list[DataFrame], drop: DataFrame, parts: list[tuple[str, str]]) -> None:
        """Write `parts` again: their rows but for those of the files in `drop`, and the fresh ones."""
        by_agent: dict[str, list[str]] = {}
        for agent, part in parts:
            by_agent.setdefault(agent, []).append(part)
        # literals, so that other parts are not even listed by the scan
        here = reduce(Column.__or__, [(F.col("agent") == a) & F.col("part").isin(p) for a, p in by_agent.items()])
        before = self._table(table)
        kept = before.where(here).join(drop.select("path"), "path", "left_anti").select(*before.columns)
        touched = self.spark.createDataFrame(parts, "agent string, part string")
        marks = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in before.schema[:-2]], "agent", "part")
        rows = reduce(DataFrame.unionByName, [kept, marks, *[f.select(*before.columns) for f in fresh]])
        order = ["agent", "part", "ts"] if table == "token_events" else ["agent", "part"]
        # a task per part, and several for one that is large
        spread = rows.hint("rebalance", "agent", "part").sortWithinPartitions(*order)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("agent", "part").parquet(f"{self.root}/{table}")

    def _hermes(self, tables: tuple[DataFrame, DataFrame], todo: DataFrame) -> dict[str, DataFrame]:
        ids = todo.where(F.col("agent") == hermes.AGENT).select(
            F.regexp_extract("path", r"session_(.*)\.json$", 1).alias("id")
        )
        stored = tables[0].join(ids, "id", "left_semi")
        messages = tables[1].join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_semi")
        return {
            "sessions": hermes.sessions(stored, messages), "token_events": hermes.token_events(stored, messages),
            "transcript_events": hermes.transcript(messages),
        }


def _new_part() -> Column:
    month = F.date_format(F.timestamp_seconds("file_mtime"), "yyyy-MM")
    return F.concat(month, F.lit("."), F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("string"))


def _stored_sessions(sessions: DataFrame) -> DataFrame:
    """Stored sessions as files: a fingerprint of what may change stands for the size."""
    told = ["message_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "ended_at", "title", "model"]
    return hermes.seen_sessions(sessions).select(
        F.concat(F.lit("sessions/session_"), "id", F.lit(".json")).alias("path"),
        F.coalesce(F.greatest("started_at", "ended_at").cast("bigint"), F.lit(0).cast("bigint")).alias("file_mtime"),
        F.xxhash64(*told).alias("file_size"),
        F.lit(hermes.AGENT).alias("agent"),
    )
