"""The SQL the usage queries must agree with."""

from __future__ import annotations

from sessionmeter.functions.ranges import RANGES
from sessionmeter.registry.tables import NOW, SAMPLE_CONTEXTS, SAMPLE_PRICES
from sessionmeter.schema import USAGE

_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in USAGE)

EVENTS = """
t AS (
  SELECT CASE user_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'hermes' ELSE 'qwen' END AS agent,
    concat('u', CAST(user_id AS VARCHAR), '-', substr(CAST(ts AS VARCHAR), 1, 10)) AS session_id,
    user_id, event_id AS ord, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type = 'signup' AS is_user_turn,
    CASE event_type WHEN 'purchase' THEN 'ALPHA-2024' WHEN 'click' THEN 'x-alpha-mini'
         WHEN 'view' THEN 'gamma' ELSE '' END AS model,
    CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS input_tokens,
    CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS output_tokens,
    CASE WHEN event_type = 'purchase' THEN event_id % 50 ELSE 0 END AS cache_read_tokens,
    CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN event_id % 13 ELSE 0 END AS cache_creation_5m_tokens,
    CASE WHEN event_type = 'click' AND event_id % 5 = 0 THEN event_id % 11 ELSE 0 END AS cache_creation_1h_tokens,
    CASE WHEN event_type = 'click' THEN event_id % 30 ELSE 0 END AS cache_creation_tokens,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS web_search_calls
  FROM events),
s AS (
  SELECT agent, session_id,
    CASE WHEN agent <> 'hermes' THEN concat('/w/u', CAST(user_id AS VARCHAR)) END AS cwd,
    CASE WHEN user_id % 3 = 0 THEN 'beta-1' END AS meta_model,
    CASE WHEN user_id % 7 <> 0 THEN concat('ask ', CAST(min(ord) AS VARCHAR)) END AS prompt,
    count(*) FILTER (is_user_turn) AS turns, max(ts) AS last_active_ts, min(ts) AS started_at_ts,
    user_id % 5 = 0 AS is_scripted
  FROM t GROUP BY agent, session_id, user_id)"""

_PRICE_ROWS = ", ".join(f"({i}, '{r[0]}', {', '.join(str(float(x)) for x in r[1:])})" for i, r in enumerate(SAMPLE_PRICES))
_CONTEXT_ROWS = ", ".join(f"({i}, '{k}', {n})" for i, (k, n) in enumerate(SAMPLE_CONTEXTS))

PRICES = f"""
price AS (SELECT * FROM (VALUES {_PRICE_ROWS}) AS p(pos, k, p_in, p_out, p_5m, p_1h, p_cr)),
names AS (SELECT model FROM t UNION SELECT coalesce(meta_model, '') FROM s),
matched AS (
  SELECT * FROM (
    SELECT n.model AS name, p.*, row_number() OVER (
      PARTITION BY n.model ORDER BY (lower(n.model) = k) DESC, length(k) DESC, pos) AS best
    FROM names n JOIN price p ON contains(lower(n.model), p.k)) x WHERE best = 1)"""

CACHED_OUT = "greatest({u}input_tokens - {u}cache_read_tokens, 0)"


def cost(p: str, u: str = "", inp: str = "{u}input_tokens") -> str:
    """Cost expression for price columns of `p` and usage columns of `u`."""
    legacy = f"CASE WHEN {u}cache_creation_5m_tokens = 0 AND {u}cache_creation_1h_tokens = 0 " \
             f"THEN {u}cache_creation_tokens ELSE {u}cache_creation_5m_tokens END"
    total = (
        f"{inp.format(u=u)} * {p}.p_in / 1e6 + {u}output_tokens * {p}.p_out / 1e6 + {u}cache_read_tokens * {p}.p_cr / 1e6"
        f" + ({legacy}) * {p}.p_5m / 1e6 + {u}cache_creation_1h_tokens * {p}.p_1h / 1e6"
        f" + {u}web_search_calls * CAST(0.01 AS DOUBLE)"
    )
    return (
        f"CASE WHEN {p}.k IS NULL THEN {u}web_search_calls * CAST(0.01 AS DOUBLE) "
        f"ELSE floor(({total}) * 1e6 + 0.5) / 1e6 END"
    )


_CALL = "NOT is_user_turn AND (input_tokens > 0 OR output_tokens > 0 OR cache_read_tokens > 0)"


def cutoff(label: str) -> int:
    seconds = RANGES[label][0]
    return NOW - seconds if seconds else 0


def scanned(label: str) -> str:
    return f"""
w AS (
  SELECT agent, session_id, {_SUMS}, count(*) FILTER ({_CALL}) AS calls,
    count(*) FILTER (is_user_turn) AS turns,
    arg_max(model, ord) FILTER (NOT is_user_turn AND model <> '') AS last_model
  FROM t WHERE ts >= {cutoff(label)} GROUP BY agent, session_id)"""


def active(label: str, kept: str = "TRUE") -> str:
    return f"""{scanned(label)},
ks AS (SELECT * FROM s WHERE {kept}),
a0 AS (
  SELECT w.*, ks.* EXCLUDE (agent, session_id, turns), coalesce(w.last_model, ks.meta_model, '') AS model
  FROM w JOIN ks ON w.agent = ks.agent AND w.session_id = ks.session_id
  WHERE w.turns > 0 OR input_tokens > 0 OR output_tokens > 0 OR cache_read_tokens > 0 OR web_search_calls > 0),
a AS (SELECT a0.*, {cost('m', 'a0.')} AS session_cost FROM a0 LEFT JOIN matched m ON m.name = a0.model)"""


def since() -> str:
    return "(SELECT min(least(started_at_ts, last_active_ts)) FROM ks WHERE least(started_at_ts, last_active_ts) > 0)"


def start(label: str) -> str:
    return str(cutoff(label)) if RANGES[label][0] else since()


def width(label: str) -> str:
    return str(RANGES[label][1]) if RANGES[label][0] else f"greatest(greatest({NOW} - {since()}, 1) // 30, 3600)"


def hours(label: str) -> str:
    if RANGES[label][0]:
        return f"CAST({RANGES[label][0] / 3600.0} AS DOUBLE)"
    return f"greatest(({NOW} - {since()}) / 3600.0, CAST(1 AS DOUBLE))"


def rate(label: str, calls: str = "sum(calls)") -> str:
    return f"round(CAST({calls} AS DOUBLE) / greatest({hours(label)}, 0.0001), 6)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def buckets(label: str) -> str:
    return f"""{active(label)},
e AS (
  SELECT t.*, coalesce(nullif(t.model, ''), a.meta_model, '') AS priced_as,
    CAST((t.ts - {start(label)}) // {width(label)} AS INTEGER) AS idx
  FROM t JOIN a ON a.agent = t.agent AND a.session_id = t.session_id
  WHERE t.ts >= {cutoff(label)} AND NOT t.is_user_turn AND t.ts >= {start(label)}),
b AS (
  SELECT e.agent, e.idx, sum({cost('m', 'e.')}) AS event_cost, count(*) FILTER ({_CALL}) AS calls
  FROM e LEFT JOIN matched m ON m.name = e.priced_as WHERE e.idx < {RANGES[label][2]} GROUP BY e.agent, e.idx)"""


def _bucket_rate(label: str, calls: str) -> str:
    return f"round({calls} / greatest({width(label)} / CAST(3600 AS DOUBLE), 0.0001), 6)"


def time_series(label: str) -> str:
    n = RANGES[label][2]
    return f"""{_with(EVENTS, PRICES, buckets(label))}
SELECT CAST(g.idx AS INTEGER) AS idx, CAST({start(label)} + g.idx * {width(label)} AS BIGINT) AS bucket_ts,
  round(coalesce(sum(b.event_cost), 0), 6) AS event_cost, CAST(coalesce(sum(b.calls), 0) AS BIGINT) AS calls,
  {_bucket_rate(label, 'coalesce(sum(b.calls), 0)')} AS calls_per_hour
FROM range({n}) g(idx) LEFT JOIN b ON b.idx = g.idx GROUP BY g.idx"""


def agent_series(measure: str, label: str) -> str:
    n = RANGES[label][2]
    value = "round(coalesce(b.event_cost, 0), 6)" if measure == "event_cost" else "CAST(coalesce(b.calls, 0) AS BIGINT)"
    return f"""{_with(EVENTS, PRICES, buckets(label))}
SELECT x.agent, CAST(g.idx AS INTEGER) AS idx, CAST({start(label)} + g.idx * {width(label)} AS BIGINT) AS bucket_ts,
  {value} AS value
FROM (SELECT agent FROM b GROUP BY agent HAVING max({measure}) > 0) x CROSS JOIN range({n}) g(idx)
LEFT JOIN b ON b.agent = x.agent AND b.idx = g.idx"""


def agents_by_peak(measure: str) -> str:
    peak = "round(max(event_cost), 6)" if measure == "event_cost" else _bucket_rate("30d", "max(calls)")
    return f"""{_with(EVENTS, PRICES, buckets('30d'))}
SELECT agent, {peak} AS peak FROM b GROUP BY agent HAVING max({measure}) > 0 ORDER BY peak DESC, agent"""


def grouped(source: str) -> str:
    """Group id per session by the running latest end."""
    return f"""
o AS (
  SELECT *, coalesce(cwd, '') AS dir, max(last_active_ts) OVER (
    PARTITION BY agent, coalesce(cwd, '') ORDER BY started_at_ts, last_active_ts DESC, session_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM {source}),
o2 AS (
  SELECT *, sum(CASE WHEN prev_end IS NULL OR started_at_ts - prev_end > 86400 THEN 1 ELSE 0 END) OVER (
    PARTITION BY agent, dir ORDER BY started_at_ts, last_active_ts DESC, session_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM o),
grp AS (
  SELECT *, concat(agent, '|', dir) AS group_key,
    sha256(concat(agent, '|', dir, '|', CAST(min(started_at_ts) OVER (PARTITION BY agent, dir, g) AS VARCHAR))) AS group_id
  FROM o2)"""


def _by_group_rows(label: str) -> str:
    return f"""{active(label)},{grouped('a')},
bg AS (
  SELECT group_id, agent, dir AS cwd, count(*) AS n_sessions,
    coalesce(last(coalesce(prompt, '') ORDER BY last_active_ts DESC, started_at_ts, session_id), '') AS prompt,
    sum(session_cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, min(started_at_ts) AS first_started_ts
  FROM grp GROUP BY group_id, agent, dir)"""


def by_group(label: str) -> str:
    return f"""{_with(EVENTS, PRICES, _by_group_rows(label))}
SELECT group_id, agent, cwd, n_sessions, prompt, round(cost, 6) AS cost, calls, first_started_ts,
  {rate(label, 'calls')} AS calls_per_hour FROM bg"""


def top_groups(measure: str) -> str:
    value = "cost" if measure == "cost" else rate("30d", "calls").replace("round(", "(").replace(", 6)", ")")
    return f"""{_with(EVENTS, PRICES, _by_group_rows('30d'))},
v AS (SELECT *, {value} AS value FROM bg)
SELECT agent, cwd, first_started_ts, n_sessions, round(value, 6) AS value,
  round(value * 100.0 / (SELECT sum(value) FROM v WHERE value > 0), 6) AS share,
  (SELECT count(*) FROM v WHERE value > 0) AS groups_above_zero
FROM v WHERE value > 0 ORDER BY v.value DESC, agent, cwd, first_started_ts LIMIT 20"""


_ROLLUP = "count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, round(sum(session_cost), 6) AS cost, CAST(sum(calls) AS BIGINT) AS calls"


def totals(label: str) -> str:
    return f"""{_with(EVENTS, PRICES, _by_group_rows(label))}
SELECT {_ROLLUP}, (SELECT count(*) FROM bg) AS groups, round({hours(label)}, 6) AS window_hours,
  {rate(label)} AS calls_per_hour FROM a"""


def by_agent(label: str, kept: str = "TRUE") -> str:
    return f"""{_with(EVENTS, PRICES, active(label, kept))}
SELECT agent, {_ROLLUP}, {rate(label)} AS calls_per_hour FROM a GROUP BY agent"""


def by_model(label: str) -> str:
    return f"""{_with(EVENTS, PRICES, active(label))}
SELECT CASE WHEN model = '' THEN '-' ELSE model END AS model, {_ROLLUP}, {_SUMS},
  {rate(label)} AS calls_per_hour FROM a GROUP BY 1"""


def session_cost(label: str) -> str:
    return f"""{_with(EVENTS, PRICES, active(label))}
SELECT agent, session_id, model, turns, calls, {', '.join(USAGE)}, round(session_cost, 6) AS session_cost FROM a"""


def bucket_specs() -> str:
    rows = [
        f"SELECT '{n}' AS \"range\", CAST({start(n)} AS BIGINT) AS bucket_start, CAST({width(n)} AS BIGINT) AS bucket_seconds, "
        f"CAST({RANGES[n][2]} AS INTEGER) AS n_buckets, round({hours(n)}, 6) AS window_hours"
        for n in RANGES
    ]
    return f"{_with(EVENTS, 'ks AS (SELECT * FROM s)')} " + " UNION ALL ".join(rows)


def range_cutoffs() -> str:
    rows = [
        f"SELECT '{n}' AS \"range\", CAST({cutoff(n)} AS BIGINT) AS cutoff, count(*) FILTER (ts >= {cutoff(n)}) AS events FROM t"
        for n in RANGES
    ]
    return f"{_with(EVENTS)} " + " UNION ALL ".join(rows)


_SHORT = "CASE agent WHEN 'claude' THEN 'CLA' WHEN 'codex' THEN 'COD' WHEN 'hermes' THEN 'HER' ELSE 'QWN' END"
_GROUP_ROWS = f"""{grouped('s')},
gr AS (
  SELECT group_id, group_key, agent, cwd, count(*) AS n_sessions, max(last_active_ts) AS latest_active_ts,
    min(started_at_ts) AS first_started_ts
  FROM grp GROUP BY group_id, group_key, agent, cwd)"""

_EVENT_COST = f"""{_with(EVENTS, PRICES)},
c AS (SELECT t.*, {{cost}} AS cost FROM t LEFT JOIN matched m ON m.name = t.model)"""

ORACLE = {
    "price_match": f"""{_with(EVENTS, PRICES)}
SELECT x.model, m.k AS price_key FROM (SELECT DISTINCT model FROM t) x LEFT JOIN matched m ON m.name = x.model""",
    "context_window": f"""{_with(EVENTS)},
ctx AS (SELECT * FROM (VALUES {_CONTEXT_ROWS}) AS p(pos, k, n)),
d AS (SELECT DISTINCT model FROM t)
SELECT d.model, CAST(coalesce((SELECT n FROM ctx WHERE contains(lower(d.model), ctx.k)
  ORDER BY length(ctx.k) DESC, pos LIMIT 1), 200000) AS BIGINT) AS context_window FROM d""",
    "event_cost_by_model": f"""{_EVENT_COST.format(cost=cost('m', 't.'))}
SELECT agent, model, round(sum(cost), 6) AS event_cost FROM c GROUP BY agent, model""",
    "cost_without_cached_input": f"""{_EVENT_COST.format(cost=cost('m', 't.', CACHED_OUT))}
SELECT model, round(sum(cost), 6) AS event_cost FROM c GROUP BY model""",
    "usage_by_agent": f"""{_with(EVENTS)}
SELECT agent, {_SUMS}, CAST(sum(cache_creation_tokens + cache_creation_5m_tokens + cache_creation_1h_tokens) AS BIGINT)
  AS cache_creation_total FROM t GROUP BY agent""",
    "window_scan_7d": f"""{_with(EVENTS, scanned('7d'))}
SELECT * EXCLUDE (session_id, last_model), session_id AS path, coalesce(last_model, '') AS last_model FROM w""",
    "active_sessions_1d": session_cost("1d"),
    "cost_with_subagents": f"""{_with(EVENTS, PRICES, active("all"))},
u AS (SELECT *, CAST(regexp_extract(session_id, '^u([0-9]+)-', 1) AS BIGINT) AS who FROM a),
p AS (SELECT *, CASE WHEN who % 5 = 1 THEN concat('u', CAST(who - 1 AS VARCHAR), regexp_extract(session_id, '^u[0-9]+(-.*)$', 1)) END AS parent FROM u)
SELECT coalesce(parent, session_id) AS path, count(parent) AS n_subagents,
  round(coalesce(sum(session_cost) FILTER (parent IS NULL), 0.0), 6) AS own_cost, round(sum(session_cost), 6) AS cost, CAST(sum(calls) AS BIGINT) AS calls
FROM p GROUP BY 1""",
    "priced_by_table": """WITH b AS (SELECT p_partkey AS pos, lower(concat(p_brand, '/', CAST(p_partkey % 1000 AS VARCHAR))) AS k, p_retailprice AS price FROM part),
m AS (SELECT DISTINCT concat('X-', p_brand, '/', CAST(p_partkey % 1500 AS VARCHAR)) AS model FROM part WHERE p_partkey % 3 = 0),
c AS (SELECT model, k, price, row_number() OVER (PARTITION BY model ORDER BY length(k) DESC, pos) AS r FROM m JOIN b ON contains(lower(model), k))
SELECT model, k AS price_key, price FROM c WHERE r = 1""",
    "session_cost_7d": session_cost("7d"),
    "session_cost_all": session_cost("all"),
    "range_cutoffs": range_cutoffs(),
    "bucket_specs": bucket_specs(),
    **{f"time_series_{n}": time_series(n) for n in RANGES},
    "agent_cost_series_7d": agent_series("event_cost", "7d"),
    "agent_calls_series_7d": agent_series("calls", "7d"),
    "agents_by_peak_cost": agents_by_peak("event_cost"),
    "agents_by_peak_calls": agents_by_peak("calls"),
    "totals_7d": totals("7d"),
    "totals_all": totals("all"),
    "cost_by_agent_1h": by_agent("1h"),
    "cost_by_agent_7d": by_agent("7d"),
    "cost_by_agent_all": by_agent("all"),
    "cost_by_model_7d": by_model("7d"),
    "cost_by_model_all": by_model("all"),
    "cost_by_group_7d": by_group("7d"),
    "cost_by_group_30d": by_group("30d"),
    "top_groups_by_cost": top_groups("cost"),
    "top_groups_by_rate": top_groups("calls_per_hour"),
    "filtered_by_agent": by_agent("30d", "agent = 'claude' AND NOT is_scripted"),
    "index_counts": f"""{_with(EVENTS)}
SELECT {_SHORT} AS agent, count(*) AS sessions, count(*) FILTER (is_scripted) AS scripted FROM s GROUP BY 1""",
    "newest_sessions": f"""{_with(EVENTS)}
SELECT {_SHORT} AS agent, session_id, turns, left(coalesce(prompt, ''), 60) AS prompt FROM s
ORDER BY last_active_ts DESC, session_id LIMIT 5""",
    "session_groups": f"{_with(EVENTS, _GROUP_ROWS)} SELECT * FROM gr",
    "session_group_of": f"{_with(EVENTS, grouped('s'))} SELECT agent, session_id, group_key, group_id FROM grp",
    "group_members": f"""{_with(EVENTS, grouped('s'))}
SELECT group_id, agent, session_id, last_active_ts, row_number() OVER m AS position,
  count(*) OVER (PARTITION BY group_id) AS n_members,
  coalesce(lag(session_id) OVER m, session_id) AS previous_id,
  coalesce(lead(session_id) OVER m, session_id) AS next_id
FROM grp WINDOW m AS (PARTITION BY group_id ORDER BY last_active_ts DESC, started_at_ts, session_id)""",
    "group_size_histogram": f"""{_with(EVENTS, _GROUP_ROWS)}
SELECT n_sessions AS size, count(*) AS groups FROM gr GROUP BY 1""",
    "largest_groups": f"""{_with(EVENTS, _GROUP_ROWS)}
SELECT n_sessions, group_key, coalesce(cwd, '-') AS cwd FROM gr
ORDER BY n_sessions DESC, latest_active_ts DESC, group_key, first_started_ts LIMIT 10""",
    "session_id_prefix": f"""{_with(EVENTS)}, f AS (SELECT * FROM s WHERE starts_with(session_id, 'u12-2024-01-1'))
SELECT session_id, session_id AS path, (SELECT count(*) FROM f) AS n_matches FROM f""",
    "sessions_by_cwd": f"""{_with(EVENTS)}
SELECT agent, session_id, last_active_ts FROM s WHERE cwd = '/w/u12'""",
    "sessions_by_day": f"""{_with(EVENTS)}
SELECT agent, session_id, last_active_ts FROM s WHERE cwd = '/w/u12'
  AND last_active_ts >= {NOW - 864_000} AND last_active_ts < {NOW - 777_600}""",
}
