"""The SQL the log queries must agree with, written straight over the given conversations."""

from __future__ import annotations

from sessionmeter.registry.logs import BASE

TERM = "the"

C = f"""
c AS (
  SELECT *, length(text) AS size, concat('c', CAST(conv_id AS VARCHAR)) AS cid,
    {BASE} + conv_id * 60 + turn AS secs,
    CASE WHEN turn % 5 = 4 THEN 0 ELSE {BASE} + conv_id * 60 + turn END AS ts,
    CASE WHEN turn % 5 = 4 THEN 'soon'
         ELSE strftime(make_timestamp(({BASE} + conv_id * 60 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS stamp,
    CAST(turn AS VARCHAR) AS tn
  FROM conversations)"""

_STARTED = "coalesce(min(secs) FILTER (turn % 5 <> 4), 1700000000 + conv_id)"
_PROMPT = "left(arg_min(text, turn) FILTER (role = 'user'), 120)"


def _sessions(agent: str, prefix: str, cwd: str, model: str, turns: str, scripted: str) -> str:
    return f"""WITH {C}
SELECT '{agent}' AS agent, concat('{prefix}', cid) AS session_id, {cwd} AS cwd, {model} AS model, {_PROMPT} AS prompt,
  CAST({turns} AS BIGINT) AS turns, 1700000000 + conv_id AS last_active_ts, {_STARTED} AS started_at_ts,
  coalesce({scripted}, false) AS is_scripted
FROM c GROUP BY conv_id, cid"""


_ZERO = {
    "input_tokens": "0", "output_tokens": "0", "cache_read_tokens": "0", "cache_creation_5m_tokens": "0",
    "cache_creation_1h_tokens": "0", "cache_creation_tokens": "0", "web_search_calls": "0",
}


def _event(agent: str, sid: str, where: str, turn: bool, model: str = "''", ts: str = "ts", source: str = "c", **usage: str) -> str:
    cols = ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in {**_ZERO, **usage}.items())
    return (
        f"SELECT '{agent}' AS agent, {sid} AS session_id, CAST({ts} AS BIGINT) AS ts, {str(turn).lower()} AS is_user_turn, "
        f"{model} AS model, {cols} FROM {source} WHERE {where}"
    )


def _events(*parts: str, before: str = C) -> str:
    return f"WITH {before} " + " UNION ALL ".join(parts)


def _say(place: int, kind: str, body: str, where: str) -> str:
    return f"SELECT conv_id, cid, turn, {place} AS place, stamp, '{kind}' AS kind, {body} AS body FROM c WHERE {where}"


def _transcript(agent: str, sid: str, *parts: str, order: str = "turn, place") -> str:
    return f"""WITH {C}, x AS ({' UNION ALL '.join(parts)})
SELECT '{agent}' AS agent, {sid} AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) - 1 AS event_index,
  stamp AS ts, kind, body FROM x"""


_CALL = """concat('{"cmd":"', repeat('ls ', 100), '","n":', tn, '}')"""
_SAID = "trim(text, ' \t\n\r') <> ''"
_CLAUDE_MODEL = "CASE WHEN conv_id % 2 = 0 THEN 'claude-sonnet-4-x' ELSE 'claude-opus-4-5-x' END"
_CODEX_MODEL = "CASE WHEN turn >= 3 THEN 'o3' WHEN conv_id % 6 <> 5 THEN 'gpt-5.3-codex' ELSE '' END"
_QWEN_MODEL = "CASE WHEN conv_id % 3 <> 0 THEN 'qwen3-coder-x' ELSE '' END"
_ISO_HALF = "strftime(make_timestamp(secs * 1000000), '%Y-%m-%dT%H:%M:%S.500+00:00')"

_HERMES = f"""{C},
hs AS (
  SELECT conv_id, cid, sum(size) AS total, count(*) AS n,
    left(arg_min(text, turn) FILTER (role = 'user' AND turn <> 5), 120) AS opening
  FROM c WHERE conv_id % 11 <> 10 GROUP BY conv_id, cid),
hm AS (SELECT *, CASE WHEN conv_id % 3 <> 0 THEN 'gemma-x' END AS model FROM c WHERE conv_id % 11 <> 10)"""
_TOOL = "(role = 'system' AND turn % 2 = 0)"
_HEADER = """CASE WHEN conv_id % 6 = 0 THEN '[run id7] ' WHEN conv_id % 3 = 0 THEN '[run] '
  WHEN conv_id % 2 = 0 THEN '[id7] ' ELSE '' END"""

_MARKED_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _slim(place: int, line: str, where: str) -> str:
    return f"SELECT conv_id, cid, turn, {place} AS place, {line} AS line FROM c WHERE {where}"


_HITS = f"""
h AS (
  SELECT cid, conv_id, turn, role, text, strpos(lower(text), '{TERM}') AS p FROM c WHERE contains(lower(text), '{TERM}')),
found AS (
  SELECT 'claude' AS agent, cid AS session_id, turn AS event_index, '' AS ts,
    CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END AS kind,
    concat(CASE WHEN p > 41 THEN '…' ELSE '' END,
      regexp_replace(substr(text, greatest(p - 40, 1), least(p + 42, length(text)) - greatest(p - 40, 1) + 1), '[\\n\\r\\t]', ' ', 'g'),
      CASE WHEN p + 42 < length(text) THEN '…' ELSE '' END) AS snippet,
    CAST(CASE WHEN p > 41 THEN 41 ELSE p - 1 END AS BIGINT) AS match_start, CAST({len(TERM)} AS BIGINT) AS match_len
  FROM h)"""
_ACTIVE = "(SELECT cid AS session_id, count(*) * 1000 + max(turn) AS last_active_ts FROM c GROUP BY cid)"

ORACLE = {
    "claude_sessions": _sessions(
        "claude", "",
        "CASE WHEN bool_or((role = 'user' AND turn % 4 = 0) OR role = 'assistant') "
        "THEN concat('/w/p', CAST(conv_id % 7 AS VARCHAR)) END",
        f"CASE WHEN bool_or(role = 'assistant') THEN {_CLAUDE_MODEL} END",
        "coalesce(sum(1 + CAST(turn % 4 <> 0 AS INTEGER) + CAST(turn % 3 = 0 AS INTEGER)) FILTER (role = 'user'), 0)",
        "conv_id % 9 = 0 OR (conv_id % 5 = 0 AND bool_or(role = 'system'))",
    ),
    "codex_sessions": _sessions(
        "codex", "codex:",
        "CASE WHEN count(*) > 3 AND conv_id % 4 = 0 THEN '/w/later' WHEN count(*) > 3 AND conv_id % 4 = 1 THEN NULL ELSE '/w/q' END",
        "CASE WHEN conv_id % 6 <> 5 THEN 'gpt-5.3-codex' WHEN count(*) > 3 THEN 'o3' END",
        "count(*) FILTER (role = 'assistant')",
        "conv_id % 5 = 0",
    ),
    "qwen_sessions": _sessions(
        "qwen", "qwen:",
        "CASE WHEN bool_or(role = 'user' AND turn > 0) THEN '/w/z' END",
        "CASE WHEN bool_or(role = 'assistant') AND conv_id % 3 <> 0 THEN 'qwen3-coder-x' END",
        "count(*) FILTER (role = 'user')",
        "conv_id % 2 = 1 AND bool_or(role = 'system')",
    ),
    "hermes_sessions": f"""WITH {_HERMES}
SELECT 'hermes' AS agent, concat('hermes:', cid) AS session_id, CAST(NULL AS VARCHAR) AS cwd,
  CASE WHEN conv_id % 3 <> 0 THEN 'gemma-x' END AS model,
  CASE WHEN conv_id % 5 = 0 THEN concat('title of ', cid) ELSE opening END AS prompt,
  n AS turns, {BASE} + conv_id * 60 + CASE WHEN conv_id % 4 = 0 THEN 0 ELSE 100 END AS last_active_ts,
  {BASE} + conv_id * 60 AS started_at_ts, false AS is_scripted FROM hs""",
    "claude_token_events": _events(
        _event("claude", "cid", "role = 'user'", True),
        _event("claude", "cid", "role = 'user' AND turn % 4 <> 0", True),
        _event(
            "claude", "cid", "role = 'assistant'", False, _CLAUDE_MODEL,
            input_tokens="size", output_tokens="size + 7", cache_read_tokens="size % 13", cache_creation_5m_tokens="size % 3",
        ),
    ),
    "codex_token_events": _events(
        _event("codex", "concat('codex:', cid)", "role = 'user'", True, _CODEX_MODEL),
        _event(
            "codex", "concat('codex:', cid)", "role = 'assistant'", False, _CODEX_MODEL,
            input_tokens="size", output_tokens="size % 50", cache_read_tokens="size % 20",
        ),
        _event("codex", "concat('codex:', cid)", "role = 'system'", False, _CODEX_MODEL, web_search_calls="1"),
    ),
    "qwen_token_events": _events(
        _event("qwen", "concat('qwen:', cid)", "role = 'user'", True),
        _event(
            "qwen", "concat('qwen:', cid)", "role = 'assistant'", False, _QWEN_MODEL,
            input_tokens="size", output_tokens="size % 40", cache_read_tokens="size % 9",
        ),
    ),
    "hermes_token_events": _events(
        _event("hermes", "concat('hermes:', cid)", "role = 'user'", True, "coalesce(model, '')", "secs", "hm"),
        _event(
            "hermes", "concat('hermes:', cid)", "TRUE", False,
            "CASE WHEN conv_id % 3 <> 0 THEN 'gemma-x' ELSE '' END", f"{BASE} + conv_id * 60", "hs",
            input_tokens="total", output_tokens="CASE WHEN conv_id % 7 = 0 THEN 0 ELSE total % 100 END + total % 5",
            cache_read_tokens="total % 30", cache_creation_tokens="total % 17",
        ),
        before=_HERMES,
    ),
    "claude_transcript": _transcript(
        "claude", "cid",
        _say(20, "User", "text", f"role = 'user' AND {_SAID}"),
        _say(21, "ToolResult", "concat('r', tn)", "role = 'user' AND turn % 4 <> 0"),
        _say(30, "ToolResult", """concat('[{"a":"x","z":', tn, '}]')""", "role = 'user' AND turn % 4 <> 0"),
        _say(50, "Thinking", "text", f"role = 'assistant' AND {_SAID}"),
        _say(60, "Assistant", "text", "role = 'assistant'"),
        _say(80, "ToolUse", f"concat('Bash: ', {_CALL})", "role = 'assistant'"),
        _say(90, "System", "text", "role = 'system'"),
    ),
    "codex_transcript": _transcript(
        "codex", "concat('codex:', cid)",
        _say(20, "User", "text", "role = 'user'"),
        _say(20, "ToolResult", "concat(chr(30), 'exit=', CAST(conv_id % 3 AS VARCHAR), chr(10), text)", "role = 'system'"),
        _say(20, "Assistant", "text", "role = 'assistant'"),
        _say(30, "ToolUse", "concat('shell: n=', tn)", "role = 'assistant'"),
    ),
    "qwen_transcript": _transcript(
        "qwen", "concat('qwen:', cid)",
        _say(0, "Thinking", "'hm'", "role = 'user'"),
        _say(1, "User", "text", "role = 'user'"),
        _say(0, "Thinking", "text", "role = 'assistant'"),
        _say(1, "Assistant", "text", "role = 'assistant'"),
        _say(2, "ToolUse", """concat('f: {"a":"x","b":', tn, '}')""", "role = 'assistant'"),
        _say(
            3, "ToolResult",
            "concat(CASE WHEN turn % 4 = 1 THEN concat('exit=1', chr(10)) ELSE '' END, "
            "CASE WHEN turn % 2 = 1 THEN '[f] ' ELSE '' END, text)",
            "role = 'assistant'",
        ),
        _say(
            0, "System",
            """concat('{"uiEvent":{"event.name":"qwen-code.api_response","prompt_id":"',
            CASE WHEN conv_id % 2 = 0 THEN 'a########b' ELSE 'solo' END, '"}}')""",
            "role = 'system'",
        ),
        _say(1, "System", "text", "role = 'system'"),
    ),
    "hermes_transcript": f"""WITH {C},
x AS (
  SELECT conv_id, cid, turn, secs, 0 AS place, 'User' AS kind, text AS body FROM c WHERE role = 'user' AND turn <> 5 AND text <> ''
  UNION ALL SELECT conv_id, cid, turn, secs, 0, 'Thinking', text FROM c WHERE role = 'assistant' AND turn % 2 = 1
  UNION ALL SELECT conv_id, cid, turn, secs, 1, 'Assistant', text FROM c WHERE role = 'assistant' AND turn <> 5
  UNION ALL SELECT conv_id, cid, turn, secs, 2, 'ToolUse', '(unparsed tool_calls) broken {{' FROM c WHERE role = 'assistant' AND conv_id % 9 = 0
  UNION ALL SELECT conv_id, cid, turn, secs, 2, 'ToolUse', concat('grep: n=', tn) FROM c WHERE role = 'assistant' AND conv_id % 9 > 1
  UNION ALL SELECT conv_id, cid, turn, secs, 3, 'ToolUse', 'bare: ' FROM c WHERE role = 'assistant' AND conv_id % 9 > 1
  UNION ALL SELECT conv_id, cid, turn, secs, 0, 'ToolResult', concat({_HEADER}, CASE WHEN turn <> 5 THEN text ELSE '' END) FROM c WHERE {_TOOL}
  UNION ALL SELECT conv_id, cid, turn, secs, 0, 'System', text FROM c WHERE role = 'system' AND NOT {_TOOL} AND turn <> 5)
SELECT 'hermes' AS agent, concat('hermes:', cid) AS session_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) - 1 AS event_index, {_ISO_HALF} AS ts, kind, body FROM x""",
    "all_sessions": f"""WITH {_HERMES},
n AS (
  SELECT conv_id, cid, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS answers,
    coalesce(sum(1 + CAST(turn % 4 <> 0 AS INTEGER) + CAST(turn % 3 = 0 AS INTEGER)) FILTER (role = 'user'), 0) AS lines
  FROM c GROUP BY conv_id, cid)
SELECT 'claude' AS agent, cid AS session_id, 1700000000 + conv_id AS last_active_ts, CAST(lines AS BIGINT) AS turns FROM n
UNION ALL SELECT 'codex', concat('codex:', cid), 1700000000 + conv_id, answers FROM n
UNION ALL SELECT 'qwen', concat('qwen:', cid), 1700000000 + conv_id, users FROM n
UNION ALL SELECT 'hermes', concat('hermes:', cid), {BASE} + conv_id * 60 + CASE WHEN conv_id % 4 = 0 THEN 0 ELSE 100 END, n FROM hs""",
    "merged_calls": """WITH r AS (
  SELECT user_id, event_id AS ord, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type = 'signup' AS is_turn, event_type = 'error' AS is_other,
    CASE event_type WHEN 'purchase' THEN 'ALPHA-2024' WHEN 'click' THEN 'x-alpha-mini' WHEN 'view' THEN 'gamma' ELSE '' END AS model,
    CAST(floor(value * 100) AS BIGINT) AS inp, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS raw_out
  FROM events),
r2 AS (
  SELECT *, CASE WHEN user_id % 3 <> 0 THEN model ELSE '' END AS mid, NOT is_turn AND NOT is_other AS is_call,
    CASE WHEN raw_out % 3 = 0 THEN 0 ELSE raw_out END AS out FROM r),
r3 AS (
  SELECT *, CASE WHEN is_call AND mid <> '' AND lag(is_call) OVER u AND lag(mid) OVER u = mid THEN 0 ELSE 1 END AS starts
  FROM r2 WINDOW u AS (PARTITION BY user_id ORDER BY ord)),
r4 AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM r3),
m AS (
  SELECT user_id, run, coalesce(arg_max(ord, ord) FILTER (out > 0), min(ord)) AS kept,
    coalesce(arg_max(model, ord) FILTER (out > 0 AND model <> ''), arg_min(model, ord)) AS model
  FROM r4 WHERE is_call GROUP BY user_id, run)
SELECT concat('u', CAST(m.user_id AS VARCHAR)) AS session_id, r2.ts, false AS is_user_turn, m.model, r2.inp AS input_tokens, r2.out AS output_tokens
FROM m JOIN r2 ON r2.user_id = m.user_id AND r2.ord = m.kept WHERE r2.inp + r2.out > 0
UNION ALL SELECT concat('u', CAST(user_id AS VARCHAR)), ts, true, '', 0, 0 FROM r2 WHERE is_turn""",
    "carried_model": """SELECT user_id, event_id,
  last_value(CASE event_type WHEN 'purchase' THEN 'ALPHA-2024' WHEN 'view' THEN 'gamma' END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS model FROM events""",
    "read_times": """SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN floor(epoch(ts)) WHEN 1 THEN floor(epoch(ts)) - 7200
  WHEN 4 THEN floor(epoch(ts)) + 19800 ELSE 0 END AS BIGINT) AS ts FROM events""",
    "transcript_labels": f"""WITH {C} SELECT cid AS session_id, turn AS event_index,
  CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'ASSIS' ELSE 'SYS  ' END AS label, greatest(turn - 3, 0) AS behind FROM c""",
    "slash_commands": f"""WITH {C} SELECT cid AS session_id, turn AS event_index,
  CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('[stdout] ', text)
    WHEN 2 THEN concat('/go ', {_MARKED_TRIM.format('text')})
    WHEN 3 THEN concat('<command-name>/go</command-name> then ', text) ELSE text END AS said FROM c""",
    "exit_codes": f"""WITH {C},
x AS ({' UNION ALL '.join([
        "SELECT conv_id, cid, turn, 20 AS place, role, text FROM c",
        "SELECT conv_id, cid, turn, 30, 'call', '' FROM c WHERE role = 'assistant'"])}),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) - 1 AS event_index FROM x)
SELECT concat('codex:', cid) AS session_id, event_index, conv_id % 3 AS exit_code, conv_id % 3 <> 0 AS failed, text AS output
FROM y WHERE role = 'system'""",
    "output_status": f"""WITH {C},
o AS (SELECT cid, turn % 3 = 0 AS failed, CASE turn % 3 WHEN 0 THEN concat('Fatal: ', text)
  WHEN 1 THEN concat(text, chr(10), 'all ok') ELSE text END AS output FROM c),
l AS (SELECT cid, lower(unnest(string_split(regexp_replace(output, '\\r?\\n$', ''), chr(10)))) AS line FROM o),
k AS (SELECT cid, regexp_matches(line, 'error|failed|fatal|panic|traceback') AS err,
  contains(line, 'success') OR contains(line, ' ok ') OR ends_with(line, ' ok') AS ok FROM l),
n AS (SELECT cid, count(*) FILTER (err) AS error_lines, count(*) FILTER (NOT err AND ok) AS ok_lines FROM k GROUP BY cid)
SELECT 'claude' AS agent, o.cid AS session_id, count(*) AS results, count(*) FILTER (failed) AS failed,
  any_value(error_lines) AS error_lines, any_value(ok_lines) AS ok_lines
FROM o JOIN n ON n.cid = o.cid GROUP BY o.cid""",
    "slim_transcript": f"""WITH {C}, x AS ({' UNION ALL '.join([
        _slim(20, "concat('[user] ', " + _MARKED_TRIM.format('text') + ")", "role = 'user'"),
        _slim(21, "'[tool_result] (omitted, id=use)'", "role = 'user' AND turn % 4 <> 0"),
        _slim(30, "'[tool_result] (omitted, id=?)'", "role = 'user' AND turn % 4 <> 0"),
        _slim(40, "'[user] meta'", "role = 'user' AND turn % 3 = 0"),
        _slim(50, "concat('[thinking] ', " + "left(" + _MARKED_TRIM.format('text') + ", 400))", "role = 'assistant'"),
        _slim(60, "concat('[assistant] ', " + _MARKED_TRIM.format('text') + ")", "role = 'assistant'"),
        _slim(80, f"concat('[tool_use] Bash ', left({_CALL}, 200))", "role = 'assistant'"),
    ])})
SELECT cid AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) - 1 AS line_no, line FROM x""",
    "search_hits": f"""WITH {C}, {_HITS}
SELECT found.*, a.last_active_ts, (SELECT count(*) FROM found) AS total_hits
FROM found JOIN {_ACTIVE} a ON a.session_id = found.session_id
ORDER BY a.last_active_ts DESC, found.session_id, found.event_index LIMIT 500""",
    "search_all_hits": f"WITH {C}, {_HITS} SELECT * FROM found",
    "search_documents": f"""WITH c AS (SELECT source AS cid, 0 AS conv_id, doc_id AS turn, 'user' AS role, text FROM documents), {_HITS}
SELECT event_index, snippet, match_start, match_len FROM found""",
    "sessions_with_prompt": f"""WITH {C}
SELECT 'claude' AS agent, a.* FROM {_ACTIVE} a
WHERE a.session_id IN (SELECT cid FROM c WHERE role = 'user' AND contains(lower(text), 'der'))""",
}
