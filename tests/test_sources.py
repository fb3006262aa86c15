"""Real files: layouts, order under many splits, refresh, streams."""

from __future__ import annotations

import gzip
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from sessionmeter.operators import claude
from sessionmeter.operators.lookup import by_id_prefix
from sessionmeter.plans.dashboard import dashboard
from sessionmeter.functions.ranges import Range
from sessionmeter.plans import store as store_module
from sessionmeter.plans.store import Store
from sessionmeter.sources import lines as L
from sessionmeter.streaming import files as stream_files

from test_rules import hermes_tables

STAMP = "2026-04-15T14:52:34Z"


def put(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def user(text):
    return {"type": "user", "timestamp": STAMP, "cwd": "/w/a", "message": {"content": text}}


def answer(mid, out):
    return {"type": "assistant", "timestamp": STAMP,
            "message": {"id": mid, "model": "claude-opus-4-5", "usage": {"input_tokens": 1, "output_tokens": out}}}


def names(df):
    return sorted(os.path.basename(r.path) for r in df.select("path").distinct().collect())


def test_layouts(spark, tmp_path):
    root = f"{tmp_path}/claude"
    put(f"{root}/-w-a/s1.jsonl", [user("one")])
    put(f"{root}/-w-a/s2.jsonl.gz", [user("two")])
    put(f"{root}/-w-a/note.txt", [user("no")])
    put(f"{root}/top.jsonl", [user("no")])
    put(f"{root}/-w-a/s1/subagents/agent-7.jsonl", [user("sub")])
    assert names(L.claude_lines(spark, root)) == ["s1.jsonl"]
    assert names(L.claude_lines(spark, root, compressed=True)) == ["s1.jsonl", "s2.jsonl.gz"]
    sub = L.claude_subagent_lines(spark, root).first()
    assert sub.parent_session_id == "s1"
    both = claude.sessions(L.claude_lines(spark, root, compressed=True).unionByName(
        L.claude_subagent_lines(spark, root).drop("parent_session_id")))
    assert sorted(r.session_id for r in both.collect()) == ["agent-7", "s1", "s2"]
    found = by_id_prefix(both, "s").collect()
    assert [(r.session_id, r.n_matches) for r in found] == [("s1", 2), ("s2", 2)]

    deep = f"{tmp_path}/codex"
    put(f"{deep}/2026/04/15/rollout-2026-04-15T14-52-34-abc.jsonl", [{}])
    put(f"{deep}/1/2/3/4/rollout-2026-04-15T14-52-34-five.jsonl", [{}])
    put(f"{deep}/1/2/3/4/5/rollout-2026-04-15T14-52-34-six.jsonl", [{}])
    put(f"{deep}/2026/rollout-short.jsonl", [{}])
    assert names(L.codex_lines(spark, deep)) == [
        "rollout-2026-04-15T14-52-34-abc.jsonl", "rollout-2026-04-15T14-52-34-five.jsonl"]
    assert names(L.list_files(spark, "codex", deep)) == names(L.codex_lines(spark, deep))

    put(f"{tmp_path}/qwen/p/chats/q1.jsonl", [user("x")])
    put(f"{tmp_path}/qwen/p/q2.jsonl", [user("x")])
    assert names(L.qwen_lines(spark, f"{tmp_path}/qwen")) == ["q1.jsonl"]
    assert L.qwen_lines(spark, f"{tmp_path}/nothing").count() == 0


def test_line_order_over_many_splits(spark, tmp_path):
    for name, n in (("a", 30_000), ("b", 500), ("c", 20_000)):
        os.makedirs(f"{tmp_path}/p", exist_ok=True)
        with open(f"{tmp_path}/p/{name}.jsonl", "w") as f:
            f.writelines(f'{{"i": {i}, "pad": "{"x" * (i % 50)}"}}\n' for i in range(n))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        with pytest.raises(ValueError):
            L.claude_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 16))
        df = L.claude_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 20
        rows = df.select("path", "ord", F.get_json_object("value", "$.i").cast("int").alias("i")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 50_500
    by_file = {}
    for r in sorted(rows, key=lambda r: (r.path, r.ord)):
        by_file.setdefault(r.path, []).append(r.i)
    assert all(seen == list(range(len(seen))) for seen in by_file.values())
    assert len({(r.path, r.ord) for r in rows}) == len(rows)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store")


def rows_of(store, table, *columns):
    return sorted(tuple(r) for r in store.read(table).select(*columns).collect())


def test_refresh(spark, tmp_path, store, monkeypatch):
    root = f"{tmp_path}/claude"
    roots = {"claude": root, "codex": f"{tmp_path}/codex"}
    os.makedirs(f"{tmp_path}/codex")
    put(f"{root}/-w-a/s1.jsonl", [user("one"), answer("m", 3)])
    put(f"{root}/-w-a/s2.jsonl", [user("two")])
    put(f"{root}/-w-a/s3.jsonl", [[]])
    assert store.refresh(roots, hermes_tables(spark)) == 4
    assert [r[0] for r in rows_of(store, "sessions", "session_id")] == ["hermes:north-17", "s1", "s2", "s3"]
    first = rows_of(store, "token_events", "session_id", "is_user_turn", "output_tokens")

    # nothing changed: nothing is read, nothing is written
    assert store.refresh(roots, hermes_tables(spark)) == 0
    assert not os.path.exists(f"{store.root}/lock")

    # one grows, one goes, one is new
    put(f"{root}/-w-a/s1.jsonl", [user("one"), answer("m", 3), answer("m", 9), user("more")])
    os.remove(f"{root}/-w-a/s2.jsonl")
    put(f"{root}/-w-b/s4.jsonl", [user("four")])
    assert store.refresh(roots) == 2
    assert [r[0] for r in rows_of(store, "sessions", "session_id")] == ["hermes:north-17", "s1", "s3", "s4"]
    got = rows_of(store, "token_events", "session_id", "is_user_turn", "output_tokens")
    assert [r for r in got if r[0] == "s1"] == [("s1", False, 9), ("s1", True, 0), ("s1", True, 0)]
    assert [r for r in got if r[0].startswith("hermes")] == [r for r in first if r[0].startswith("hermes")]
    said = rows_of(store, "transcript_events", "session_id", "event_index", "body")
    assert [r for r in said if r[0] == "s1"] == [("s1", 0, "one"), ("s1", 1, "more")]
    assert not [r for r in said if r[0] == "s2"]

    # a refresh that dies before its manifest is done again by the next
    put(f"{root}/-w-b/s4.jsonl", [user("four"), user("five")])
    monkeypatch.setattr(store, "_rewrite", lambda table, *rest: None if table == "manifest" else Store._rewrite(store, table, *rest))
    store.refresh(roots)
    monkeypatch.undo()
    assert store.refresh(roots) == 1
    assert [r for r in rows_of(store, "sessions", "session_id", "turns") if r[0] == "s4"] == [("s4", 2)]

    # all files of a part gone: no row is left behind
    for name in ("-w-a/s1", "-w-a/s3", "-w-b/s4"):
        os.remove(f"{root}/{name}.jsonl")
    assert store.refresh(roots) == 0
    for table in ("sessions", "token_events", "transcript_events"):
        assert {r[0] for r in rows_of(store, table, "agent")} == {"hermes"}


def test_files_that_come_during_a_refresh(spark, tmp_path, store, monkeypatch):
    """A file that appears after the listing waits for the next refresh, and none is ever stored twice."""
    root = f"{tmp_path}/claude"
    put(f"{root}/-w-a/s0.jsonl", [user("0")])
    listing = store_module.list_files
    for k in range(1, 6):

        def list_then_add(spark_, agent, root_, wide=False, since=None, k=k):
            found = spark_.createDataFrame(listing(spark_, agent, root_, wide).collect(), L.FILE_SCHEMA)
            put(f"{root}/-w-a/s{k}.jsonl", [user(str(k))])
            put(f"{root}/-w-a/s0.jsonl", [user("0")] * (k + 1))
            return found

        monkeypatch.setattr(store_module, "list_files", list_then_add)
        store.refresh({"claude": root})
        assert rows_of(store, "sessions", "session_id") == [(f"s{i}",) for i in range(k)]
    monkeypatch.setattr(store_module, "list_files", listing)
    store.refresh({"claude": root})
    want = sorted([("s0", "0")] * 6 + [(f"s{i}", str(i)) for i in range(1, 6)])
    assert rows_of(store, "transcript_events", "session_id", "body") == want
    assert rows_of(store, "sessions", "session_id", "turns") == [("s0", 6)] + [(f"s{i}", 1) for i in range(1, 6)]

    # a mistyped root is an error, and all rows stay
    with pytest.raises(FileNotFoundError):
        store.refresh({"claude": f"{tmp_path}/clawed"})
    assert rows_of(store, "transcript_events", "session_id", "body") == want


def test_two_refreshes_at_once(spark, tmp_path, store):
    root = f"{tmp_path}/claude"
    for i in range(5):
        put(f"{root}/-w-{i}/s{i}.jsonl", [user(str(i))])
    errors = []

    def run():
        try:
            Store(spark, store.root).refresh({"claude": root})
        except Exception as err:  # noqa: BLE001
            errors.append(err)

    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    put(f"{root}/-w-9/s9.jsonl", [user("9")])
    for t in threads:
        t.join()
    assert not errors
    store.refresh({"claude": root})
    assert rows_of(store, "transcript_events", "session_id", "body") == [(f"s{i}", str(i)) for i in (0, 1, 2, 3, 4, 9)]

    # a lock that someone left behind long ago is no obstacle, a fresh one is waited for
    lock = f"{store.root}/lock"
    put(lock, [])
    os.utime(lock, (1, 1))
    assert store.refresh({"claude": root}) == 0
    put(lock, [])
    with pytest.raises(TimeoutError), store._locked(wait_seconds=0):
        pass


def test_refresh_of_recent_days_only(spark, tmp_path, store):
    root = f"{tmp_path}/codex"
    line = {"type": "event_msg", "timestamp": STAMP, "payload": {"type": "user_message", "message": "x"}}

    def day(d, name, n):
        put(f"{root}/2026/04/{d}/rollout-2026-04-{d}T14-52-34-{name}.jsonl", [line] * n)

    day("10", "a", 1)
    day("15", "b", 1)
    assert store.refresh({"codex": root}) == 2
    day("10", "a", 2)
    day("15", "b", 3)
    day("16", "c", 1)
    assert store.refresh({"codex": root}, since="2026-04-15") == 2
    count = {"codex:a": 1, "codex:b": 3, "codex:c": 1}
    assert {r[0]: r[1] for r in store.read("transcript_events").groupBy("session_id").count().collect()} == count
    assert store.refresh({"codex": root}) == 1


def test_refresh_reads_changed_totals_subagents_and_compressed_logs(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", wide=True)
    root = f"{tmp_path}/claude"
    put(f"{root}/-w-a/s1.jsonl", [user("one")])
    put(f"{root}/-w-a/s2.jsonl.gz", [user("two")])
    put(f"{root}/-w-a/s1/subagents/agent-7.jsonl", [user("sub")])
    sessions, messages = hermes_tables(spark)
    assert store.refresh({"claude": root}, (sessions, messages)) == 4
    # subagents are told apart from sessions, and belong to one
    assert [r[0] for r in rows_of(store, "sessions", "session_id")] == ["hermes:north-17", "s1", "s2"]
    assert store.read("token_events").count() == 4
    everyone = store.read("sessions", subagents=True)
    child = everyone.where("parent_path is not null").first()
    assert child.session_id == "agent-7" and child.parent_path == everyone.where("session_id = 's1'").first().path
    later = sessions.withColumn("output_tokens", F.col("output_tokens") + F.when(F.col("id") == "north-17", 5).otherwise(0))
    assert store.refresh({"claude": root}, (later, messages)) == 1
    spent = [r for r in rows_of(store, "token_events", "session_id", "is_user_turn", "output_tokens") if r[0].startswith("hermes")]
    assert spent == [("hermes:north-17", False, 70), ("hermes:north-17", True, 0)]


def test_dashboard_from_files(spark, tmp_path, store):
    put(f"{tmp_path}/claude/-w-a/s1.jsonl", [user("one"), answer("m", 1_000_000)])
    store.refresh({"claude": f"{tmp_path}/claude"})
    now = 1_776_264_754 + 60
    r = Range("1h", now)
    parts = dashboard(store.read("token_events", since=r.cutoff), store.read("sessions"), r)
    total = parts["totals"].first()
    assert (total.sessions, total.groups, total.turns, total.calls) == (1, 1, 1, 1)
    assert total.cost == pytest.approx(25.000005)
    assert [x.agent for x in parts["by_time_agent"].select("agent").distinct().collect()] == ["claude"]
    assert parts["top_by_cost"].first().share == 100.0
    assert sum(x.event_cost for x in parts["by_time"].collect()) == pytest.approx(25.000005)


def test_refresh_interval():
    assert [stream_files.interval(n) for n in (0, 1, 30, 99_999)] == [0, 5, 30, 3_600]


def test_refresh_every(spark, tmp_path, store):
    put(f"{tmp_path}/claude/-w-a/s1.jsonl", [user("one")])
    query = stream_files.refresh_every(store, {"claude": f"{tmp_path}/claude"}, f"{tmp_path}/cp", seconds=3_600)
    try:
        for _ in range(60):
            if query.lastProgress is not None:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert store.read("sessions").count() == 1
    assert stream_files.refresh_every(store, {}, f"{tmp_path}/cp2", seconds=0) is None
