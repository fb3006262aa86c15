"""Hand-made vectors, one per rule."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionmeter.functions import jsonval, pricing, text, times
from sessionmeter.functions.ranges import Range
from sessionmeter.operators import claude, codex, grouping, hermes, output, qwen, search, series, usage
from sessionmeter.schema import USAGE

STAMP = "2026-04-15T14:52:34Z"


def lines(spark, rows, path="/logs/-w-a/s1.jsonl", mtime=1_000):
    data = [(path, mtime, 0, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "path string, file_mtime bigint, file_size bigint, ord bigint, value string")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def answer(mid, inp, out, model="m", **extra):
    return {
        "type": "assistant", "timestamp": STAMP,
        "message": {"id": mid, "model": model, "usage": {"input_tokens": inp, "output_tokens": out}, **extra},
    }


def test_streaming_merge(spark):
    rows = [
        answer("m1", 10, 1), answer("m1", 99, 0), {"type": "user", "isMeta": True}, "torn {", answer("m1", 12, 7),
        answer("m1", 50, 50, "<synthetic>"), answer("m1", 13, 8), {"type": "assistant"}, {"type": "user"},
        answer("m1", 13, 9), answer("", 1, 1), answer("", 2, 2), {"type": "system"}, answer("m2", 0, 0),
    ]
    got = claude.token_events(lines(spark, rows)).orderBy("ord").collect()
    calls = [(r.input_tokens, r.output_tokens) for r in got if not r.is_user_turn]
    assert calls == [(13, 8), (13, 9), (1, 1), (2, 2)]
    assert sum(r.is_user_turn for r in got) == 1


def test_merge_keeps_first_usage_and_last_named_model(spark):
    rows = [answer("a", 5, 0, "one"), answer("a", 6, 0, "two"), answer("b", 1, 1, "x"), answer("b", 2, 3, "")]
    got = claude.token_events(lines(spark, rows)).orderBy("ord").collect()
    assert [(r.input_tokens, r.output_tokens, r.model) for r in got] == [(5, 0, "one"), (2, 3, "x")]


def test_lines_that_are_not_objects_break_a_run(spark):
    rows = [answer("a", 1, 1), "[1]", answer("a", 2, 2)]
    assert claude.token_events(lines(spark, rows)).count() == 2


def test_strict_numbers(spark):
    value = F.parse_json(F.lit('{"a": 5.0, "b": "7", "c": -4, "d": 3, "e": 1e2}'))
    assert [one(spark, jsonval.count_at(value, f"$.{k}")) for k in "abcdez"] == [0, 0, 0, 3, 0, 0]


def test_strict_lines(spark):
    def parsed(raw):
        return one(spark, F.to_json(jsonval.parse_line(F.lit(raw))))

    assert parsed('{"a":1,"a":2}') == '{"a":2}'
    assert parsed('{"a":1} x') is None
    assert parsed('{"a":1},{"b":2}') is None
    assert parsed("") is None
    assert parsed("  ") is None
    assert parsed('"text"') == '"text"'


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2026-04-15", None), ("2026-04-15T14:52:34", None), ("2026-04-15T14:52:34Z", 1_776_264_754),
        ("2026-04-15t14:52:34.554z", 1_776_264_754), ("2026-04-15T16:52:34.1+02:00", 1_776_264_754),
        ("1960-01-01T00:00:00Z", 0), ("later", None), ("2026-13-15T14:52:34Z", None),
        ("2026-04-15T14:52:34.123456789Z", 1_776_264_754),
    ],
)
def test_times(spark, raw, want):
    assert one(spark, times.rfc3339_seconds(F.lit(raw))) == want


def test_real_time(spark):
    assert one(spark, times.real_iso(F.lit(1_776_758_400.0))) == "2026-04-21T08:00:00+00:00"
    assert one(spark, times.real_seconds(F.lit(-3.5))) == 0
    assert one(spark, times.real_seconds(F.lit(None).cast("double"))) == 0


def test_price_match(spark):
    book = pricing.PriceBook([("alpha", 1, 1, 1, 1, 1), ("alpha-mini", 2, 2, 2, 2, 2)])
    got = [one(spark, book.key(F.lit(m))) for m in ("ALPHA-2024", "x-alpha-mini", "gamma", "")]
    assert got == ["alpha", "alpha-mini", None, None]


def test_price_ties_go_by_table_order(spark):
    book = pricing.PriceBook([("ab", 1, 0, 0, 0, 0), ("bc", 2, 0, 0, 0, 0)])
    assert one(spark, book.key(F.lit("abc"))) == "ab"


def test_price_book_is_bounded():
    with pytest.raises(ValueError):
        pricing.PriceBook([(f"k{i}", 0, 0, 0, 0, 0) for i in range(pricing.MAX_BOOK_ROWS + 1)])


def test_price_table_agrees_with_the_ladder(spark):
    fields = "pos int, key string, inp double, out double, cw5m double, cw1h double, cr double"
    rows = [(i, *r) for i, r in enumerate(pricing.PRICES)]
    names = ["CLAUDE-Opus-4-5-x", "x-o3-pro", "gpt-5.3-codex", "gpt-5", "", None, "o3", "claude-opus-4-6+o4-mini", "my.gguf"]
    usage_ = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens", "cache_creation_tokens", "web_search_calls"]
    df = spark.createDataFrame([(i, n, *range(1, 8)) for i, n in enumerate(names)], "i int, model string, " + ", ".join(f"{c} bigint" for c in usage_))
    table = spark.createDataFrame(rows, fields)
    want = pricing.with_cost(df, pricing.price_book(table), F.col("model"), "cost").orderBy("i").collect()
    assert isinstance(pricing.price_book(table), pricing.PriceBook)
    assert pricing.with_cost(df, pricing.PriceTable(table), F.col("model"), "cost").orderBy("i").select(*df.columns, "cost").collect() == want

    # ten thousand keys of all lengths, equal ones too
    r = random.Random(3)
    keys = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(10_000)]
    big = pricing.price_book(spark.createDataFrame([(i, k, float(i), 0.0, 0.0, 0.0, 0.0) for i, k in enumerate(keys)], fields))
    models = ["".join(r.choice("abcD") for _ in range(r.randint(0, 12))) for _ in range(200)]
    got = {x.model: (x.key, x.price.inp) for x in big.matched(spark.createDataFrame([(m,) for m in models], "model string")).collect()}
    for m in models:
        found = [(-len(k), i, k) for i, k in enumerate(keys) if k in m.lower()] if m else []
        assert got.get(m) == ((min(found)[2], float(min(found)[1])) if found else None)


def test_price_book_from_table(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (0, "aa", 1.0)], "pos int, k string, v double")
    assert pricing.KeyedBook.from_table(df, "k", "v").rows == [("aa", 1.0), ("b", 2.0)]


def test_default_books(spark):
    prices, contexts = pricing.default_prices(), pricing.default_contexts()
    assert one(spark, prices.key(F.lit("gpt-4.1-mini-2025"))) == "gpt-4.1-mini"
    assert one(spark, prices.prices(F.lit("claude-opus-4-20250514"))).inp == 15.0
    assert one(spark, prices.prices(F.lit("some-LLAMA.gguf"))).out == 0.0
    assert one(spark, contexts.window(F.lit("claude-sonnet-4-6-x"))) == 1_000_000
    assert one(spark, contexts.window(F.lit("other"))) == 200_000


def cost(spark, model, **used):
    row = spark.range(1).select(*[F.lit(used.get(c, 0)).cast("bigint").alias(c) for c in USAGE])
    return pricing.with_cost(row, pricing.default_prices(), F.lit(model), "c").first().c


def test_cost(spark):
    million = 1_000_000
    model = "claude-opus-4-5"
    assert cost(spark, model, cache_creation_tokens=million) == 6.25
    both = dict(cache_creation_tokens=million, cache_creation_5m_tokens=4 * million, cache_creation_1h_tokens=million)
    assert cost(spark, model, **both) == 4 * 6.25 + 10.0
    assert cost(spark, "nobody", input_tokens=million, web_search_calls=3) == pytest.approx(0.03)
    assert cost(spark, model, input_tokens=1) == 0.000005
    # cached tokens stay in the input count
    assert cost(spark, "gpt-5.3", input_tokens=million, cache_read_tokens=million) == 2.5


def test_group_gap(spark):
    ends = [(0, 100), (50, 60), (86_500, 86_505), (172_906, 172_907)]
    rows = [("claude", f"s{i}", f"p{i}", "/w", a, b) for i, (a, b) in enumerate(ends)]
    df = spark.createDataFrame(
        rows, "agent string, session_id string, path string, cwd string, started_at_ts bigint, last_active_ts bigint"
    )
    got = {r.session_id: r.group_id for r in grouping.group_sessions(df).collect()}
    assert got["s0"] == got["s1"] == got["s2"] != got["s3"]


def usage_rows(spark, rows):
    """rows: (ts, turn, model, input)"""
    data = [("claude", "p", "s", i, ts, turn, model, inp, *[0] * 6) for i, (ts, turn, model, inp) in enumerate(rows)]
    cols = ", ".join(f"{c} bigint" for c in USAGE)
    return spark.createDataFrame(
        data, f"agent string, path string, session_id string, ord bigint, ts bigint, is_user_turn boolean, model string, {cols}"
    )


def session_rows(spark, model="alpha"):
    return spark.createDataFrame(
        [("claude", "s", "p", None, model, None, 1, 9_000, 1_000, False)],
        "agent string, session_id string, path string, cwd string, model string, prompt string, turns bigint, "
        "last_active_ts bigint, started_at_ts bigint, is_scripted boolean",
    )


BOOK = pricing.PriceBook([("alpha", 1.0, 0, 0, 0, 0), ("beta", 2.0, 0, 0, 0, 0)])


def test_buckets(spark):
    now = 100_000
    at = [now - 3_600, now - 3_301, now - 3_300, now, 0]
    events = usage_rows(spark, [(t, False, "alpha", 10) for t in at])
    sessions, r = session_rows(spark), Range("1h", now)
    active = usage.per_session(events, sessions, r, BOOK)
    got = series.time_series(series.bucket_sums(events, active, sessions, r, BOOK), sessions, r)
    assert [x.calls for x in got.orderBy("idx").collect()] == [2, 1] + [0] * 10


def test_session_cost_and_event_cost_differ(spark):
    """The session is priced with its last model, each event with its own."""
    now = 10_000
    events = usage_rows(spark, [(9_000, False, "alpha", 10**6), (9_100, False, "beta", 10**6), (9_200, False, "", 10**6)])
    sessions, r = session_rows(spark), Range("1h", now)
    active = usage.per_session(events, sessions, r, BOOK)
    assert active.first().session_cost == 6.0
    sums = series.bucket_sums(events, active, sessions, r, BOOK)
    assert sums.agg(F.sum("event_cost")).first()[0] == 4.0


def test_unreadable_time_counts_only_in_all(spark):
    events = usage_rows(spark, [(0, False, "alpha", 5)])
    sessions = session_rows(spark)
    assert usage.per_session(events, sessions, Range("all", 10**6), BOOK).first().input_tokens == 5
    assert usage.per_session(events, sessions, Range("30d", 10**9), BOOK).count() == 0


def test_cache_writes_alone_are_not_active(spark):
    events = usage_rows(spark, [(5, False, "alpha", 0)]).withColumn("cache_creation_tokens", F.lit(9).cast("bigint"))
    assert usage.per_session(events, session_rows(spark), Range("all", 10**6), BOOK).count() == 0


def test_exit_code(spark):
    def split(body):
        return one(spark, text.exit_code(F.lit(body))), one(spark, text.without_exit_code(F.lit(body)))

    assert split("\u001eexit=2\nboom") == (2, "boom")
    assert split("\u001eexit=-1") == (-1, "")
    assert split("exit=2\nboom") == (None, "exit=2\nboom")
    assert split("\u001eexit=2x\nboom") == (None, "\u001eexit=2x\nboom")


def test_slash_commands(spark):
    def fold(raw):
        return one(spark, text.fold_command_tags(F.lit(raw)))

    assert fold(" <local-command-caveat>a\nb</local-command-caveat>\n") is None
    assert fold("<local-command-stdout> \u001b[1mhi\u001b[0m </local-command-stdout>") == "[stdout] hi"
    assert fold("<command-name>/x</command-name>\n<command-args>a\nb</command-args>") == "/x a\nb"
    assert fold("<command-name>/x</command-name><command-message>m</command-message>") == "/x"
    assert fold("<command-name>/x</command-name> and more") == "<command-name>/x</command-name> and more"
    assert fold("plain") == "plain"


def test_line_status(spark):
    got = [one(spark, text.line_status(F.lit(s))) for s in ("Success but FAILED", "all ok", "it is ok now", "okay", "token")]
    assert got == ["error", "ok", "ok", "", ""]


def test_labels(spark):
    assert one(spark, text.short_path(F.lit("/home/al/deep/app"))) == "/h/a/d/app"
    assert one(spark, text.short_path(F.lit("/"))) == "/"
    assert one(spark, text.short_path(F.lit("app"))) == "app"
    assert one(spark, text.encoded_dir(F.lit("/home/al/x"))) == "-home-al-x"
    assert one(spark, text.cut(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.thousands(F.lit(1_234_567))) == "1,234,567"
    assert [one(spark, times.duration_label(F.lit(n))) for n in (59, 60, 7_199, 200_000)] == ["59s", "1m", "1h", "2d"]
    assert one(spark, times.minute_label(F.lit(0))) == ""


def test_claude_summary(spark):
    rows = [
        "torn", {"type": "queue-operation"}, {"type": "user", "cwd": 5, "message": {"content": "<local-command-caveat>x</local-command-caveat>"}},
        {"type": "user", "cwd": "/w/a", "timestamp": "bad", "message": {"content": [{"type": "image"}, {"type": "text", "text": "x" * 200}]}},
        {"type": "assistant", "timestamp": STAMP, "message": {"model": "<synthetic>"}},
        {"type": "user", "isMeta": True, "message": {"content": "late"}},
    ]
    got = claude.sessions(lines(spark, rows)).first()
    assert (got.session_id, got.cwd, got.model, got.turns) == ("s1", "/w/a", "<synthetic>", 3)
    assert got.prompt == "x" * 120 and got.is_scripted
    assert (got.started_at_ts, got.last_active_ts) == (1_776_264_754, 1_000)


def test_summary_of_unreadable_file(spark):
    got = claude.sessions(lines(spark, ["torn", ""])).first()
    assert (got.turns, got.started_at_ts, got.is_scripted, got.prompt) == (0, 1_000, False, None)


def test_claude_transcript(spark):
    rows = [
        {"type": "user", "message": {"content": [
            {"type": "text", "text": " "}, {"type": "tool_result", "content": {"b": 1, "a": [True]}}, {"type": "tool_result"}]}},
        {"type": "assistant", "timestamp": STAMP, "message": {"content": [
            {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "input": {"z": 1}}, {"type": "text", "text": 5}]}},
        {"type": "system", "content": {"no": "text"}},
        {"type": "system", "content": "note"},
    ]
    got = claude.transcript(lines(spark, rows)).orderBy("event_index").collect()
    assert [(r.event_index, r.kind, r.body) for r in got] == [
        (0, "ToolResult", '{"a":[true],"b":1}'), (1, "ToolResult", ""), (2, "Thinking", "hm"),
        (3, "ToolUse", 'tool: {"z":1}'), (4, "System", "note"),
    ]
    assert got[2].ts == STAMP and got[0].ts == ""


def codex_path(sid="abc"):
    return f"/logs/2026/04/15/rollout-2026-04-15T14-52-34-{sid}.jsonl"


def test_codex_rules(spark):
    rows = [
        {"type": "session_meta", "payload": {"cwd": "/w/a", "source": "exec"}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "hello"}},
        {"type": "turn_context", "payload": {"model": "one"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 4}}}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": None}},
        {"type": "turn_context", "payload": {"model": 7}},
        {"type": "event_msg", "payload": {"type": "web_search_end"}},
        {"type": "session_meta", "payload": {}},
        {"type": "event_msg", "payload": {"type": "exec_command_end", "exit_code": 3, "aggregated_output": "boom"}},
        {"type": "response_item", "payload": {"type": "function_call"}},
        {"type": "event_msg", "payload": {"type": "task_complete"}},
    ]
    df = lines(spark, rows, codex_path())
    s = codex.sessions(df).first()
    assert (s.session_id, s.cwd, s.model, s.prompt, s.turns, s.is_scripted) == ("codex:abc", None, "one", "hello", 1, True)
    events = codex.token_events(df).orderBy("ord").collect()
    assert [(e.is_user_turn, e.model, e.input_tokens, e.web_search_calls) for e in events] == [
        (True, "", 0, 0), (False, "one", 4, 0), (False, "one", 0, 1)
    ]
    said = codex.transcript(df).orderBy("event_index").collect()
    assert [(e.kind, e.body) for e in said] == [("User", "hello"), ("ToolResult", "\u001eexit=3\nboom"), ("ToolUse", "fn: ")]
    split = output.with_exit_codes(codex.transcript(df)).where("kind = 'ToolResult'").first()
    assert (split.exit_code, split.failed, split.output) == (3, True, "boom")


def test_qwen_rules(spark):
    def reply(pid):
        return {"type": "system", "subtype": "ui_telemetry",
                "systemPayload": {"uiEvent": {"event.name": "qwen-code.api_response", "prompt_id": pid}}}

    path = "/q/p/chats/s9.jsonl"
    user = {"type": "user", "message": {"parts": [{"text": "think", "thought": True}, {"text": "ask"}]}}
    tool = {"type": "tool_result", "toolCallResult": {"status": "error"},
            "message": {"parts": [{"functionResponse": {"response": {"x": 1}}}, {"functionCall": {}}, {"text": 3}]}}
    df = lines(spark, [user, reply("solo"), tool], path)
    s = qwen.sessions(df).first()
    assert (s.session_id, s.prompt, s.turns, s.is_scripted) == ("qwen:s9", "ask", 1, True)
    assert not qwen.sessions(lines(spark, [user, reply("solo"), reply("a########1")], path)).first().is_scripted
    got = [(r.kind, r.body) for r in qwen.transcript(df).orderBy("event_index").collect()]
    assert got[:2] == [("Thinking", "think"), ("User", "ask")]
    assert got[3:] == [("ToolResult", 'exit=1\n{"x":1}'), ("ToolUse", "fn: ")]


def hermes_tables(spark):
    from sessionmeter.sources.stored import MESSAGES, SESSIONS

    sid = "north-17"
    sessions = spark.createDataFrame(
        [(sid, "model-k", 1700000010.0, 1700000900.5, 3, 500, 40, 70, 0, 25, None),
         ("idle", None, 5.0, None, 0, 0, 0, 0, 0, 0, None)], SESSIONS)
    messages = spark.createDataFrame(
        [(1, sid, "user", "count the birds", None, None, None, 1700000011.0, None),
         (2, sid, "assistant", "there are nine", None, None, None, 1700000012.0, "look at the roof")], MESSAGES)
    return sessions, messages


def test_hermes_rules(spark):
    sessions, messages = hermes_tables(spark)
    s = hermes.sessions(sessions, messages).collect()
    assert [(x.prompt, x.turns, x.last_active_ts, x.cwd) for x in s] == [("count the birds", 3, 1700000900, None)]
    events = hermes.token_events(sessions, messages).orderBy("ord").collect()
    assert [(e.is_user_turn, e.output_tokens) for e in events] == [(True, 0), (False, 65)]
    said = hermes.transcript(messages).orderBy("event_index").collect()
    assert [(e.kind, e.body) for e in said] == [("User", "count the birds"), ("Thinking", "look at the roof"), ("Assistant", "there are nine")]


def test_hermes_tool_calls(spark):
    def calls(raw):
        return one(spark, hermes.tool_calls(F.lit(raw)))

    assert calls('[{"id":"c1","function":{"name":"grep","arguments":"{\\"p\\":1}"}}, {"name":"x"}]') == ['grep: {"p":1}', "x: "]
    assert calls("[{broken") == ["(unparsed tool_calls) [{broken"]
    assert calls('{"a":1}') == []
    assert one(spark, hermes.tool_calls(F.lit(None).cast("string"))) == []


def transcript_rows(spark, *bodies):
    data = [("claude", "p", "s", i, "", "User", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(
        data, "agent string, path string, session_id string, event_index bigint, ts string, kind string, body string"
    )


def test_search(spark):
    body = "x" * 50 + "\nNEEDLE.*\t" + "y" * 50 + " needle.*"
    rows = transcript_rows(spark, body, "NEEDLExx", "😀 needle.*")
    got = search.hits(rows, "needle.*").orderBy("event_index").collect()
    assert [r.event_index for r in got] == [0, 2]
    first = got[0]
    assert first.snippet == "…" + "x" * 39 + " NEEDLE.* " + "y" * 39 + "…"
    assert first.snippet[first.match_start : first.match_start + first.match_len] == "NEEDLE.*"
    assert got[1].match_start == 2
    assert search.hits(rows, "").count() == 0
    assert search.hits(transcript_rows(spark, r"a\Eb"), r"\eB").count() == 1
    assert search.hits(transcript_rows(spark, "ÉTÉ"), "été").count() == 1
