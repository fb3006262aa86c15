"""The SQL the queries over written logs must agree with: that of the same logs as rows."""

from __future__ import annotations

from sessionmeter.registry import log_sql

_AGENTS = ("claude", "codex", "qwen", "hermes")


def _all(part: str, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM ({log_sql.ORACLE[f'{a}_{part}']})" for a in _AGENTS)


ORACLE = {
    "stored_sessions": _all("sessions", "agent, session_id, cwd, model, prompt, turns, is_scripted"),
    "stored_usage": f"""WITH e AS ({_all("token_events", "agent, session_id, is_user_turn, input_tokens, output_tokens")}),
s AS ({_all("transcript", "agent, session_id, event_index")}),
spent AS (SELECT agent, session_id, count(*) FILTER (is_user_turn) AS turns, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM e GROUP BY ALL),
said AS (SELECT agent, session_id, count(*) AS events, max(event_index) AS last_index FROM s GROUP BY ALL)
SELECT * FROM spent JOIN said USING (agent, session_id)""",
    "home_projects": """SELECT coalesce(source, 'none') AS home, 'claude' AS agent, concat('-w-', CAST(doc_id % 10 AS VARCHAR)) AS encoded,
  concat('w', CAST(doc_id % 10 AS VARCHAR)) AS name, count(DISTINCT doc_id) + CAST(doc_id % 10 < 2 AS BIGINT) AS n_files
FROM documents WHERE doc_id % 10 < 5 GROUP BY source, doc_id % 10""",
}
