"""Operators that keep state between micro-batches, on Spark's arbitrary stateful processing.

Lines of a file may come in any number of micro-batches, as long as a later one holds later lines. What must be
remembered of a file is one row: the call that is still open, or the model in force. Of a directory it is the list of
its session groups, which lie more than a gap apart and are therefore few, however many sessions there are.

State is kept by bucket: all files or directories of one of `BUCKETS` buckets are one row of it, which is read and
written once per micro-batch. A call of Python per file, with its own messages to the state store, costs milliseconds.

State is kept in RocksDB below the checkpoint folder, so a lost executor costs its task. A stream that runs all the
time may drop entries not touched for `keep_seconds`; what they stand for has been given out before. A stream that ends
when it has taken all there is must not: with a time to live Spark never stops asking for another micro-batch.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sessionmeter.operators import claude, codex, qwen
from sessionmeter.operators.claude import NO_ID
from sessionmeter.operators.grouping import DEFAULT_GAP
from sessionmeter.schema import TOKEN_COLUMNS, USAGE

USAGE_FIELDS = ", ".join(f"{c} bigint" for c in USAGE)
EVENT_FIELDS = f"agent string, path string, session_id string, ord bigint, ts bigint, is_user_turn boolean, model string, {USAGE_FIELDS}"
# `call` is the first line of the call and names it; a call that is not `done` is given out again when it goes on
CALL_FIELDS = f"{EVENT_FIELDS}, call bigint, done boolean"
NAMES = [f.split()[0] for f in CALL_FIELDS.split(", ")]
# fixed for the life of a checkpoint; a million files are a thousand entries in each
BUCKETS = 1024


def with_state_store(spark: SparkSession) -> SparkSession:
    """Stateful processing asks for this store; only changes are written per micro-batch."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def _milliseconds(seconds: int | None) -> int | None:
    return None if seconds is None else seconds * 1000


def _time_mode(keep_seconds: int | None) -> str:
    return "None" if keep_seconds is None else "ProcessingTime"


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")


def _integers(column: pd.Series) -> list[int | None]:
    """Pandas turns whole numbers into floats where one is missing."""
    return [int(v) if v == v and v is not None else None for v in column.tolist()]


class Remembered:
    """The rows a bucket remembers, as one value of parallel arrays; with a time to live each has its own age."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, fields: str, ttl: int | None = None):
        columns = [f.split(" ", 1) for f in f"{fields}, touched bigint".split(", ")]
        self._state = handle.getValueState(name, ", ".join(f"{n} array<{t}>" for n, t in columns), ttl)
        self._ttl = ttl

    def rows(self, timer_values) -> dict[tuple, int]:
        """Rows with the time (ms) they were last touched, 0 without a time to live."""
        value = self._state.get()
        found = {} if value is None else {tuple(row[:-1]): row[-1] for row in zip(*value)}
        if self._ttl is None:
            return found
        oldest = self.now(timer_values) - self._ttl
        return {row: touched for row, touched in found.items() if touched >= oldest}

    def now(self, timer_values) -> int:
        return 0 if self._ttl is None else timer_values.getCurrentProcessingTimeInMs()

    def keep(self, rows: dict[tuple, int]) -> None:
        if rows:
            self._state.update(tuple(map(list, zip(*[(*row, touched) for row, touched in rows.items()]))))
        else:
            self._state.clear()


class Calls:
    """The merge of streamed lines as a machine that takes one line after the other."""

    def __init__(self, agent: str, path: str, open_call: tuple | None):
        self._agent, self._path, self.open, self.out = agent, path, open_call, []

    def take(self, session_id: str, ord_: int, kind: str, ts: int, model: str, mid: str, usage: tuple) -> None:
        has_output = usage[1] is not None and usage[1] > 0
        if kind == "assistant" and mid and self.open is not None and self.open[1] == mid:
            if has_output:
                self.open = (session_id, mid, self.open[2], ord_, ts, model or self.open[5], *usage)
            return
        self._close(True)
        if kind == "assistant":
            self.open = (session_id, mid or NO_ID, ord_, ord_, ts, model, *usage)
        elif kind == "user":
            self.out.append((self._agent, self._path, session_id, ord_, ts, True, "", *[0] * len(USAGE), ord_, True))

    def _close(self, done: bool) -> None:
        if self.open is not None:
            session_id, _, call, ord_, ts, model, *usage = self.open
            if None not in usage[:-1] and sum(usage[:-1]) > 0:
                self.out.append((self._agent, self._path, session_id, ord_, ts, False, model, *usage, call, done))
        if done:
            self.open = None

    def so_far(self) -> list[tuple]:
        """All that was given out, the open call included."""
        self._close(False)
        return self.out


class OpenCalls(StatefulProcessor):
    def __init__(self, agent: str, keep_seconds: int | None):
        self._agent, self._ttl = agent, _milliseconds(keep_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = f"path string, session_id string, mid string, call bigint, ord bigint, ts bigint, model string, {USAGE_FIELDS}"
        self._open = Remembered(handle, "open", fields, self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("ord", kind="stable")
        before, now = self._open.rows(timerValues), self._open.now(timerValues)
        open_calls = {row[0]: row[1:] for row in before}
        files: dict[str, Calls] = {}
        usage = zip(*[_integers(part[c]) for c in USAGE])
        for path, *row in zip(*[part[c].tolist() for c in ("path", "session_id", "ord", "kind", "ts", "model", "mid")], usage):
            if path not in files:
                files[path] = Calls(self._agent, path, open_calls.get(path))
            files[path].take(*row)
        out = [event for calls in files.values() for event in calls.so_far()]
        kept = {row: touched for row, touched in before.items() if row[0] not in files}
        self._open.keep(kept | {(path, *calls.open): now for path, calls in files.items() if calls.open is not None})
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


ROLE_FIELDS = "path string, session_id string, ord bigint, role string, ts bigint, carried string, inp bigint, out bigint, cached bigint"


class CarriedModel(StatefulProcessor):
    def __init__(self, keep_seconds: int | None):
        self._ttl = _milliseconds(keep_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._model = Remembered(handle, "model", "path string, model string", self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True).sort_values("ord", kind="stable")
        before, now = self._model.rows(timerValues), self._model.now(timerValues)
        models = {path: model for path, model in before}
        carried = []
        for path, model in zip(part["path"].tolist(), part["set_model"].tolist()):
            if isinstance(model, str):
                models[path] = model
            carried.append(models.get(path))
        part["carried"] = pd.Series(carried, dtype=object, index=part.index)
        # also when unchanged: that renews its time to live
        here = set(part["path"].tolist())
        kept = {row: touched for row, touched in before.items() if row[0] not in here}
        self._model.keep(kept | {(path, models[path]): now for path in here if path in models})
        yield part[[f.split()[0] for f in ROLE_FIELDS.split(", ")]]

    def close(self) -> None:
        pass


def merged_calls(rows: DataFrame, agent: str, keep_seconds: int | None = None) -> DataFrame:
    """Streamed `rows` as `claude.merge_streamed` takes them, merged; with `call` and `done`."""
    with_state_store(rows.sparkSession)
    missing = {c: F.lit(0).cast("bigint") for c in USAGE if c not in rows.columns}
    kept = rows.withColumns(missing).select("path", "session_id", "ord", "kind", "ts", "model", "mid", *USAGE, _bucket("path"))
    return kept.groupBy("bucket").transformWithStateInPandas(OpenCalls(agent, keep_seconds), CALL_FIELDS, "Update", _time_mode(keep_seconds))


def token_events(lines: DataFrame, agent: str, keep_seconds: int | None = None) -> DataFrame:
    """Token events, with `call` and `done`, of a stream of lines (path, ord, value)."""
    if agent == claude.AGENT:
        return merged_calls(claude.call_rows(lines), agent, keep_seconds)
    if agent == codex.AGENT:
        with_state_store(lines.sparkSession)
        carried = codex.role_rows(lines).withColumn("bucket", _bucket("path")).groupBy("bucket").transformWithStateInPandas(
            CarriedModel(keep_seconds), ROLE_FIELDS, "Update", _time_mode(keep_seconds)
        )
        events = codex.events_with_model(carried)
    else:
        events = qwen.token_events(lines)  # each line for itself
    return events.withColumns({"call": F.col("ord"), "done": F.lit(True)})


def current_events(written: DataFrame) -> DataFrame:
    """The token events of all micro-batches so far: of a call given out several times the latest."""
    ids = ["path", "call"]
    done = written.where("done")
    early = written.where("not done")
    # at most one open call per file and micro-batch, so these joins are small next to the events
    latest = early.groupBy(*ids).agg(F.max("stream_batch").alias("stream_batch"))
    still_open = early.join(latest, [*ids, "stream_batch"]).join(done.select(*ids), ids, "left_anti")
    return done.select(*TOKEN_COLUMNS).unionByName(still_open.select(*TOKEN_COLUMNS))


Part = tuple[int, int, int]  # first start, latest activity, sessions


def merge_parts(parts: list[Part], gap: int) -> list[Part]:
    """Session groups, or parts of them, joined to groups.

    A part reaches from its first start to `gap` seconds behind its latest activity, and parts that touch are one. A
    session whose activity ends more than `gap` before its own start reaches nowhere: it joins what reaches its start,
    or stays alone.
    """
    whole: list[list[int]] = []
    alone: list[Part] = []
    for start, end, n in sorted(parts):
        if end + gap < start:
            alone.append((start, end, n))
        elif whole and start - whole[-1][1] <= gap:
            whole[-1][1] = max(whole[-1][1], end)
            whole[-1][2] += n
        else:
            whole.append([start, end, n])
    starts = [w[0] for w in whole]
    kept = []
    for start, end, n in alone:
        i = bisect_right(starts, start) - 1
        if i >= 0 and start - whole[i][1] <= gap:
            whole[i][2] += n
        else:
            kept.append((start, end, n))
    return sorted([*map(tuple, whole), *kept])


PART_FIELDS = "agent string, dir string, start bigint, end bigint, n bigint"
GROUP_FIELDS = "agent string, dir string, first_started_ts bigint, latest_active_ts bigint, n_sessions bigint"


class Groups(StatefulProcessor):
    def __init__(self, gap: int):
        self._gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._groups = Remembered(handle, "groups", "agent string, dir string, start bigint, end bigint, n bigint, nth bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, fresh = defaultdict(list), defaultdict(list)
        for agent, folder, start, end, n, _ in self._groups.rows(timerValues):
            known[agent, folder].append((start, end, n))
        for part in rows:
            for agent, folder, *span in zip(*[part[c].tolist() for c in ("agent", "dir", "start", "end", "n")]):
                fresh[agent, folder].append(tuple(span))
        changed = {folder: merge_parts([*known.get(folder, []), *parts], self._gap) for folder, parts in fresh.items()}
        # equal groups of a directory, of sessions that reach nowhere, are told apart by their number
        whole = [(*folder, *part, i) for folder, parts in (known | changed).items() for i, part in enumerate(parts)]
        self._groups.keep(dict.fromkeys(whole, 0))
        out = [(*folder, *part) for folder, parts in changed.items() for part in parts]
        yield pd.DataFrame(out, columns=[f.split()[0] for f in GROUP_FIELDS.split(", ")])

    def close(self) -> None:
        pass


def session_groups(sessions: DataFrame, gap: int = DEFAULT_GAP) -> DataFrame:
    """All groups of each (agent, directory) that a micro-batch has new sessions of; a session comes once.

    The sessions of a task are merged to parts before the shuffle, so a directory with a large share of all
    sessions sends a few rows per task.
    """
    with_state_store(sessions.sparkSession)
    start = F.coalesce("started_at_ts", F.lit(0).cast("bigint"))
    rows = sessions.select(
        "agent", F.coalesce("cwd", F.lit("")).alias("dir"), start.alias("start"), F.coalesce("last_active_ts", start).alias("end"),
    )

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            spans = defaultdict(list)
            for agent, folder, start, end in zip(*[part[c].tolist() for c in ("agent", "dir", "start", "end")]):
                spans[agent, folder].append((start, end, 1))
            out = [(*folder, *p) for folder, own in spans.items() for p in merge_parts(own, gap)]
            yield pd.DataFrame(out, columns=["agent", "dir", "start", "end", "n"])

    parts = rows.mapInPandas(combine, PART_FIELDS).withColumn("bucket", _bucket("agent", "dir"))
    return parts.groupBy("bucket").transformWithStateInPandas(Groups(gap), GROUP_FIELDS, "Update", "None")
