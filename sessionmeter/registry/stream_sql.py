"""The SQL the stream queries must agree with: that of their batch forms."""

from __future__ import annotations

from sessionmeter.registry import log_sql, usage_sql

ORACLE = {
    "streamed_calls": log_sql.ORACLE["merged_calls"],
    "streamed_claude_events": log_sql.ORACLE["claude_token_events"],
    "streamed_codex_events": log_sql.ORACLE["codex_token_events"],
    "streamed_buckets": f"""WITH {usage_sql.EVENTS}, {usage_sql.PRICES}
SELECT t.ts // 21600 * 21600 AS bucket_ts, agent, round(sum({usage_sql.cost('m', 't.')}), 6) AS event_cost,
  count(*) FILTER (input_tokens > 0 OR output_tokens > 0 OR cache_read_tokens > 0) AS calls
FROM t LEFT JOIN matched m ON m.name = t.model WHERE NOT is_user_turn GROUP BY 1, 2""",
    "streamed_groups": f"""WITH {usage_sql.EVENTS}, {usage_sql.grouped('s')}
SELECT agent, dir AS cwd, count(*) AS n_sessions, max(last_active_ts) AS latest_active_ts, min(started_at_ts) AS first_started_ts
FROM grp GROUP BY agent, dir, g""",
}
