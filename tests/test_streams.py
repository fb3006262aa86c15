"""Streams: state over micro-batches, late rows, restarts; each against the batch form."""

from __future__ import annotations

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionmeter.operators import claude, codex
from sessionmeter.operators.grouping import group_sessions
from sessionmeter.registry import tables as T
from sessionmeter.sources import lines as L
from sessionmeter.streaming import files as stream_files
from sessionmeter.streaming import state, windows

from test_sources import answer, put, user

LINES = "path string, session_id string, ord long, value string"


class Landing:
    """A folder of parts; a stream over it is run to its end after each."""

    def __init__(self, spark, folder, schema, start):
        self.spark, self.folder, self.schema, self.start = spark, str(folder), schema, start

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.run()

    def run(self):
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
        self.start(stream, f"{self.folder}/sink", f"{self.folder}/cp").awaitTermination()

    def written(self):
        return self.spark.read.parquet(f"{self.folder}/sink")


def started(agent):
    return lambda stream, sink, cp: stream_files.run_batches(state.token_events(stream, agent), lambda rows: rows, sink, cp, "update")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_calls_that_span_micro_batches(spark, tmp_path):
    def call(mid, out, model="claude-opus-4-5"):
        row = answer(mid, out)
        row["message"]["model"] = model
        return row

    file = [
        user("a"), call("m", 0), call("m", 4), {"type": "user", "isMeta": True}, call("m", 9, ""), call("", 1), call("", 2), user("b"),
        call("n", 0), call("n", 0), {"type": "system"}, call("n", 3), call("z", 5), call("z", 6),
    ]
    lines = [("p", "s", i, json.dumps(x)) for i, x in enumerate(file)]
    other = [("q", "t", i, json.dumps(x)) for i, x in enumerate([call("m", 1), call("m", 2)])]
    landing = Landing(spark, tmp_path, LINES, started("claude"))
    open_calls = []
    for first, last in ((0, 3), (3, 4), (4, 9), (9, 13), (13, 14)):
        landing.add(lines[first:last][::-1] + (other[:1] if first == 0 else other[1:] if first == 9 else []))
        seen = spark.createDataFrame(lines[:last] + (other if first >= 9 else other[:1]), LINES)
        assert rows_of(state.current_events(landing.written())) == rows_of(claude.token_events(seen))
        open_calls.append(landing.written().where("not done").count())
    assert open_calls[0] == 2 and open_calls[-1] > 2
    # nothing new: a restart changes nothing
    before = rows_of(landing.written())
    landing.run()
    assert rows_of(landing.written()) == before


def test_model_that_spans_micro_batches(spark, tmp_path):
    def event(sub, **fields):
        return {"type": "event_msg", "timestamp": "2026-04-15T14:52:34Z", "payload": {"type": sub, **fields}}

    spent = event("token_count", info={"last_token_usage": {"input_tokens": 3, "output_tokens": 1}})
    file = [spent, {"type": "turn_context", "payload": {"model": "o3"}}, event("user_message", message="x"), spent, spent,
            {"type": "turn_context", "payload": {}}, spent, {"type": "turn_context", "payload": {"model": "o4"}}, event("web_search_end")]
    lines = [("p", "s", i, json.dumps(x)) for i, x in enumerate(file)]
    landing = Landing(spark, tmp_path, LINES, started("codex"))
    for first, last in ((0, 1), (1, 2), (2, 4), (4, 7), (7, 9)):
        landing.add(lines[first:last][::-1])
    want = rows_of(codex.token_events(spark.createDataFrame(lines, LINES)))
    assert [r[6] for r in sorted(want, key=lambda r: r[3])] == ["", "o3", "o3", "o3", "o3", "o4"]
    assert rows_of(state.current_events(landing.written())) == want


SESSIONS = "agent string, session_id string, path string, cwd string, started_at_ts bigint, last_active_ts bigint"


def test_groups_of_late_open_and_odd_sessions(spark, tmp_path):
    day = 86_400
    spans = [(100, 100), (90, 90), (200, 200), (101, 101), (201, 201), (95, 60), (300, 250), (300, 250), (150, 150), (102, 149), (300, 301), (299, 300)]
    rows = [("claude", f"s{i}", f"/p/{i}", None if i % 5 == 4 else "/w/a", a * day, b * day + 10) for i, (a, b) in enumerate(spans)]
    landing = Landing(spark, tmp_path, SESSIONS, windows.stream_groups)
    for first, last in ((0, 2), (2, 8), (8, 12)):
        landing.add(rows[first:last])
        grouped = group_sessions(spark.createDataFrame(rows[:last], SESSIONS)).groupBy(
            "agent", F.coalesce("cwd", F.lit("")).alias("cwd"), "group_id"
        ).agg(F.min("started_at_ts").alias("first_started_ts"), F.max("last_active_ts").alias("latest_active_ts"), F.count(F.lit(1)).alias("n_sessions"))
        want = grouped.drop("group_id")
        assert rows_of(windows.current_groups(landing.written()).select(*want.columns)) == rows_of(want)
    # only directories with new sessions are given out again
    landing.add([("claude", "new", "/p/new", "/w/b", day, day)])
    newest = landing.written().agg(F.max("stream_batch")).first()[0]
    assert [r.dir for r in landing.written().where(F.col("stream_batch") == newest).collect()] == ["/w/b"]


def brute_groups(spans, gap):
    out, seen = [], None
    for second in sorted({s for s, _ in spans}):
        own = [e for s, e in spans if s == second]
        fresh = seen is None or second - seen > gap
        reached = max([*own, *([] if seen is None else [seen])])
        if second - reached > gap:
            out += [[second, e, 1] for e in own]
        elif fresh:
            out.append([second, max(own), len(own)])
        else:
            last = max((g for g in out if g[1] + gap >= g[0]), key=lambda g: g[0])
            last[1], last[2] = max(last[1], *own), last[2] + len(own)
        seen = reached
    return sorted(map(tuple, out))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(-12, 20)), max_size=12), st.integers(0, 6), st.randoms())
def test_parts_merge_in_any_order(pairs, gap, r):
    spans = [(s, s + d) for s, d in pairs]
    parts: list = []
    shuffled = [(s, e, 1) for s, e in spans]
    r.shuffle(shuffled)
    while shuffled:
        k = r.randint(1, len(shuffled))
        some, shuffled = state.merge_parts(shuffled[:k], gap), shuffled[k:]
        parts = state.merge_parts(parts + some, gap)
    assert parts == brute_groups(spans, gap)


def test_late_events_correct_their_bucket(spark, tmp_path):
    rows = [("claude", "p", "s", i, ts, False, "alpha", *[1_000_000, 0, 0, 0, 0, 0, 0]) for i, ts in enumerate((90_000, 10, 2_000_000, 95_000, 20))]
    schema = T.token_events(spark, "/root/testdata/sf0.001").schema
    landing = Landing(spark, tmp_path, schema, lambda s, sink, cp: windows.stream_buckets(s, T.sample_prices(), 86_400, sink, cp))
    for r in rows:
        landing.add([r])
    got = rows_of(windows.current_buckets(landing.written()).select("bucket_ts", "event_cost", "calls"))
    assert got == [(0, 6.0, 2), (1_987_200, 3.0, 1), (86_400, 6.0, 2)]
    # a micro-batch gives out the buckets it has changed, no others
    assert landing.written().groupBy("stream_batch").count().agg(F.max("count")).first()[0] == 1


def test_stream_of_files_equals_batch(spark, tmp_path):
    root = f"{tmp_path}/claude"
    for i in range(7):
        put(f"{root}/-w-{i % 2}/s{i}.jsonl", [user("a"), answer("m", 1), answer("m", 2 + i), user("b")])
    sink = f"{tmp_path}/sink"
    stream_files.stream_token_events(spark, "claude", root, sink, f"{tmp_path}/cp", files_per_trigger=3).awaitTermination()
    columns = ["session_id", "ts", "is_user_turn", "model", "input_tokens", "output_tokens"]
    streamed = spark.read.parquet(sink)
    assert streamed.select("stream_batch").distinct().count() == 3
    want = claude.token_events(L.claude_lines(spark, root)).select(*columns)
    assert sorted(streamed.select(*columns).collect()) == sorted(want.collect())


def test_stream_keeps_the_rules_of_places(spark, tmp_path):
    root = f"{tmp_path}/codex"
    log = [{"type": "event_msg", "payload": {"type": "user_message", "message": "x"}}]
    for name in ("2026/04/15/rollout-2026-04-15T14-52-34-abc", "1/2/3/4/5/rollout-2026-04-15T14-52-34-six", "rollout-short", "other"):
        put(f"{root}/{name}.jsonl", log)
    stream_files.stream_token_events(spark, "codex", root, f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination()
    assert [r.session_id for r in spark.read.parquet(f"{tmp_path}/sink").collect()] == ["codex:abc"]


def test_state_may_be_dropped_after_a_while(spark, tmp_path):
    rows = [("p", "s", i, json.dumps(x)) for i, x in enumerate([answer("m", 1), answer("m", 2), user("a")])]
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LINES).parquet(f"{tmp_path}/in")
    events = state.token_events(stream, "claude", keep_seconds=60)
    query = events.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(
        lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/sink/stream_batch={i}")
    ).start()
    try:
        for _ in range(120):
            if query.lastProgress is not None and query.lastProgress["numInputRows"]:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    got = state.current_events(spark.read.parquet(f"{tmp_path}/sink"))
    assert rows_of(got.select("ord", "is_user_turn", "output_tokens")) == [(1, False, 2), (2, True, 0)]


class Clock:
    now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Handle:
    """A value state in memory."""

    value = None

    def getValueState(self, name, schema, ttl):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_remembered_rows_age_one_by_one():
    clock, handle = Clock(), Handle()
    kept = state.Remembered(handle, "x", "path string", 60)
    kept.keep({("a",): kept.now(clock)})
    clock.now = 50
    kept.keep(kept.rows(clock) | {("b",): kept.now(clock)})
    clock.now = 80
    assert kept.rows(clock) == {("b",): 50}
    kept.keep({})
    assert handle.value is None and kept.rows(clock) == {}


def test_state_is_kept_by_bucket(spark, tmp_path):
    """However many files and directories there are, Python is called once per bucket."""
    many = state.BUCKETS + 500
    lines = [(f"p{i}", f"s{i}", k, json.dumps(x)) for i in range(many) for k, x in enumerate([answer("m", 1), answer("m", 2 + i % 3)])]
    sessions = [("claude", f"s{i}", f"/p/{i}", f"/w/{i}", 10, 20) for i in range(many)]
    rows_in_state = []

    def counting(start):
        def run(stream, sink, cp):
            query = start(stream, sink, cp)
            query.awaitTermination()
            rows_in_state.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
            return query

        return run

    calls = Landing(spark, tmp_path / "calls", LINES, counting(started("claude")))
    calls.add([x for x in lines if x[2] == 0])
    calls.add([x for x in lines if x[2] == 1])
    assert rows_of(state.current_events(calls.written())) == rows_of(claude.token_events(spark.createDataFrame(lines, LINES)))
    groups = Landing(spark, tmp_path / "groups", SESSIONS, counting(windows.stream_groups))
    groups.add(sessions)
    assert windows.current_groups(groups.written()).count() == many
    assert all(0 < n <= state.BUCKETS for n in rows_in_state)
