"""Order-dependent operators against plain loops, with chunks small enough that their borders matter."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sessionmeter.operators import claude, grouping
from sessionmeter.operators.ordered import CHUNK_BITS, carry_last, number_rows, sum_before

STEP = 1 << (CHUNK_BITS - 2)  # four rows per chunk


def merge_loop(rows):
    """One file's rows (ord, kind, ts, model, mid, inp, out) folded one by one."""
    done, run = [], None

    def close():
        nonlocal run
        if run and (run["inp"] or run["out"]):
            done.append((run["ts"], run["model"], run["inp"], run["out"]))
        run = None

    for _, kind, ts, model, mid, inp, out in rows:
        if kind != "assistant":
            close()
        elif run and mid and run["mid"] == mid:
            if out > 0:
                run.update(ts=ts, inp=inp, out=out, model=model or run["model"])
        else:
            close()
            run = {"mid": mid or "_anon", "ts": ts, "model": model, "inp": inp, "out": out}
    close()
    return done


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_over_chunk_borders(spark, seed):
    rnd = random.Random(seed)
    data, want = [], {}
    for path in ("hot", "b", "c"):
        rows = []
        for i in range(900 if path == "hot" else 40):
            kind = rnd.choices(["assistant", "user", "other"], [12, 1, 1])[0]
            rows.append((i * STEP, kind, i, rnd.choice(["", "m1", "m2"]), rnd.choice(["a", "a", "a", "b", ""]), rnd.randint(0, 3), rnd.randint(0, 2)))
        want[path] = merge_loop(rows)
        data += [(path, path, *r) for r in rows]
    df = spark.createDataFrame(
        data, "path string, session_id string, ord bigint, kind string, ts bigint, model string, mid string, input_tokens bigint, output_tokens bigint"
    )
    got = {}
    for r in claude.merge_streamed(df, "claude").where("NOT is_user_turn").orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.ts, r.model, r.input_tokens, r.output_tokens))
    assert got == want


def test_one_run_over_many_chunks(spark):
    rows = [("p", "p", i * STEP, "assistant", i, "m", "same", 1, 1 + i % 5) for i in range(200)]
    df = spark.createDataFrame(
        rows, "path string, session_id string, ord bigint, kind string, ts bigint, model string, mid string, input_tokens bigint, output_tokens bigint"
    )
    got = claude.merge_streamed(df, "claude").collect()
    assert [(r.ts, r.output_tokens) for r in got] == [(199, 5)]


def test_carry_and_numbers(spark):
    rnd = random.Random(5)
    rows = [(k, i * STEP, rnd.choice([None] * 9 + ["x", "y"])) for k, n in (("hot", 700), ("b", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, ord bigint, v string")
    got = {(r.k, r.ord): r.c for r in carry_last(df, ["k"], "v", "c").collect()}
    last = {}
    for k, o, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert got[(k, o)] == last[k]
    numbered = number_rows(df, ["k"], ["ord"], F.shiftright("ord", CHUNK_BITS), "n")
    assert all(r.n == r.ord // STEP for r in numbered.collect())


def test_sums_of_one_hot_key_with_ties(spark):
    df = spark.range(5_000).select(F.lit("k").alias("k"), (F.col("id") % 3).alias("at"), F.col("id"), (F.col("id") % 4).alias("v"))
    got = {r.id: r.n for r in sum_before(df, ["k"], [F.desc("at"), F.asc("id")], "v", "n").collect()}
    total = 0
    for i in sorted(range(5_000), key=lambda i: (-(i % 3), i)):
        assert got[i] == total
        total += i % 4


def group_loop(rows, gap):
    """Groups of one key; rows are (id, start, last)."""
    groups, end = [], 0
    for sid, start, last in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        if groups and not (start > end and start - end > gap):
            groups[-1].add(sid)
        else:
            groups.append({sid})
        end = max(end, last)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_groups_against_loop(spark, seed):
    """Also sessions that end before they start, as copied files do, and equal starts."""
    rnd = random.Random(seed)
    rows = []
    for cwd, n in ((None, 400), ("/w/a", 60)):
        for i in range(n):
            start = rnd.randint(0, 400) * rnd.choice([1, 50, 900])
            rows.append((cwd, f"s{i}", start, max(start + rnd.choice([0, 10, 500, 5_000, -2_000, -90_000]), 0)))
    df = spark.createDataFrame(
        [("claude", s, f"{c}/{s}", c, a, b) for c, s, a, b in rows],
        "agent string, session_id string, path string, cwd string, started_at_ts bigint, last_active_ts bigint",
    )
    gap = 1_000
    got = {}
    for r in grouping.group_sessions(df, gap).collect():
        got.setdefault((r.cwd, r.group_id), set()).add(r.session_id)
    for cwd in (None, "/w/a"):
        want = group_loop([(s, a, b) for c, s, a, b in rows if c == cwd], gap)
        assert {frozenset(g) for (c, _), g in got.items() if c == cwd} == want
    assert grouping.group_count(df, gap).first().groups == len(got)
    assert grouping.group_count(df.limit(0), gap).first().groups == 0


def test_members_of_one_large_group(spark):
    df = spark.range(3_000).select(
        F.when(F.col("id") < 2_990, "big").otherwise("small").alias("group_id"), F.lit("claude").alias("agent"), F.format_string("s%05d", F.col("id")).alias("session_id"),
        F.lit("p").alias("path"), (F.col("id") % 7).alias("last_active_ts"), (F.col("id") % 11).alias("started_at_ts"),
    )
    rows = df.collect()
    got = {r.session_id: (r.position, r.n_members, r.previous_id, r.next_id) for r in grouping.members(df).collect()}
    assert len(got) == 3_000
    for group in ("big", "small"):
        ids = [r.session_id for r in sorted((r for r in rows if r.group_id == group), key=lambda r: (-r.last_active_ts, r.started_at_ts, r.session_id))]
        for i, s in enumerate(ids):
            assert got[s] == (i + 1, len(ids), ids[max(i - 1, 0)], ids[min(i + 1, len(ids) - 1)])
