"""The SQL the file queries must agree with."""

from __future__ import annotations

from sessionmeter.registry.tables import NOW

_D = """
d AS (
  SELECT *, concat('h', CAST(doc_id // 100 AS VARCHAR)) AS home, CAST(doc_id AS VARCHAR) AS id,
    CAST(doc_id // 20 AS VARCHAR) AS sk FROM documents),
f AS (
  SELECT doc_id, home, n_chars AS size, doc_id * 7 % 1000 AS mtime, source, CASE
    WHEN doc_id % 10 = 0 THEN concat('.claude/projects/-w-', source, '/memory/d', id, '.md')
    WHEN doc_id % 20 = 1 THEN concat('.claude/skills/s', sk, '/SKILL.md')
    WHEN doc_id % 20 = 11 THEN concat('.claude/skills/s', sk, '/AGENTS.md')
    WHEN doc_id % 20 = 12 THEN concat('.codex/skills/k', sk, '/AGENTS.md')
    WHEN doc_id % 20 = 2 THEN concat('.qwen/skills/q', sk, '/docs/d', id, '.txt')
    WHEN doc_id % 100 = 3 THEN '.claude/CLAUDE.md' WHEN doc_id % 100 = 13 THEN '.codex/AGENTS.md'
    WHEN doc_id % 100 = 23 THEN '.codex/rules/default.rules' WHEN doc_id % 100 = 33 THEN '.qwen/settings.json'
    WHEN doc_id % 100 = 43 THEN '.qwen/output-language.md'
    WHEN doc_id % 10 = 4 THEN concat('w/d', id, '/CLAUDE.md')
    WHEN doc_id % 10 = 5 THEN concat('w/d', CAST(doc_id - 1 AS VARCHAR), '/.claude/CLAUDE.md')
    ELSE concat('notes/d', id, '.txt') END AS path
  FROM d),
lines AS (
  SELECT home, doc_id AS ord, doc_id // 3 * 11 % 500 AS log_mtime, concat('log', CAST(doc_id // 3 AS VARCHAR)) AS log,
    CASE WHEN doc_id % 10 = 4 THEN concat('-home-', home, '-w-d', id) ELSE concat('-w-', source) END AS encoded,
    CASE WHEN doc_id % 10 = 4 THEN concat('/home/', home, '/w/d', id)
         WHEN doc_id % 3 <> 0 THEN concat('/w/', source, '/v', CAST(doc_id % 4 AS VARCHAR)) END AS cwd
  FROM d),
per_log AS (
  SELECT home, encoded, log, max(log_mtime) AS m, arg_min(cwd, ord) FILTER (cwd IS NOT NULL) AS cwd
  FROM lines GROUP BY home, encoded, log),
ranked AS (SELECT *, row_number() OVER (PARTITION BY home, encoded ORDER BY m DESC, log) AS r FROM per_log),
cwds AS (
  SELECT home, encoded, arg_min(cwd, r) FILTER (cwd IS NOT NULL) AS cwd FROM ranked WHERE r <= 3
  GROUP BY home, encoded HAVING count(cwd) > 0),
mem AS (
  SELECT f.home, 'claude' AS agent, c.encoded, regexp_extract(c.cwd, '([^/]+)$', 1) AS name,
    CASE WHEN f.doc_id % 10 = 0 THEN 'auto-memory' WHEN f.doc_id % 10 = 4 THEN 'CLAUDE.md' ELSE '.claude/CLAUDE.md' END AS category,
    CASE WHEN f.doc_id % 10 = 0 THEN f.path ELSE concat('/home/', f.home, '/', f.path) END AS path, c.cwd, f.size, f.mtime
  FROM f JOIN cwds c ON c.home = f.home AND (
    (f.doc_id % 10 = 0 AND c.encoded = concat('-w-', f.source))
    OR (f.doc_id % 10 IN (4, 5) AND concat('/home/', f.home, '/', f.path) IN (concat(c.cwd, '/CLAUDE.md'), concat(c.cwd, '/.claude/CLAUDE.md'))))
  UNION ALL
  SELECT home, CASE WHEN path LIKE '.codex%' THEN 'codex' ELSE 'qwen' END, CASE WHEN path LIKE '.codex%' THEN '_codex_global' ELSE '_qwen_global' END,
    CASE WHEN path LIKE '.codex%' THEN 'codex (global)' ELSE 'qwen (global)' END, regexp_extract(path, '([^/]+)$', 1), path,
    CASE WHEN path LIKE '.codex%' THEN '.codex' ELSE '.qwen' END, size, mtime
  FROM f WHERE path IN ('.codex/AGENTS.md', '.codex/rules/default.rules', '.qwen/settings.json', '.qwen/output-language.md')),
sf AS (
  SELECT home, regexp_extract(path, '^\\.([a-z]+)/skills/', 1) AS agent, regexp_extract(path, '/skills/([^/]+)/', 1) AS name,
    regexp_extract(path, '/skills/[^/]+/(.*)$', 1) AS rel_path, size, doc_id
  FROM f WHERE path LIKE '.%/skills/%')"""

_ABOUT = "CASE WHEN doc_id % 40 = 12 THEN '' ELSE concat('about ', CAST(doc_id AS VARCHAR)) END"

ORACLE = {
    "project_cwds": f"WITH {_D} SELECT home, encoded, cwd FROM cwds",
    "memory_files": f"WITH {_D} SELECT home, agent, encoded, name, category, path, size, mtime FROM mem",
    "memory_projects": f"""WITH {_D}
SELECT home, agent, encoded, min(name) AS name, min(cwd) AS cwd, count(*) AS n_files, max(mtime) AS latest_mtime
FROM mem GROUP BY home, agent, encoded""",
    "memory_listing": f"""WITH {_D}
SELECT home, '~/.claude/CLAUDE.md (global)' AS label, 'claude' AS agent, path FROM f WHERE path = '.claude/CLAUDE.md'
UNION ALL SELECT home, concat('[', agent, '] ', name, ' · ', category), agent, path FROM mem""",
    "skills": f"""WITH {_D}
SELECT home, agent, name, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size,
  coalesce(max(CASE WHEN rel_path = 'SKILL.md' THEN {_ABOUT} END), max(CASE WHEN rel_path = 'AGENTS.md' THEN {_ABOUT} END), '') AS description
FROM sf GROUP BY home, agent, name""",
    "skill_files": f"WITH {_D} SELECT home, agent, name, rel_path, size FROM sf",
    "manifest_changes": """SELECT concat('d', CAST(doc_id AS VARCHAR)) AS path, n_chars AS file_size FROM documents
WHERE doc_id % 13 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0)""",
    "manifest_gone": "SELECT concat('d', CAST(doc_id AS VARCHAR)) AS path FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 13 = 0",
    "time_labels": f"""WITH e AS (
  SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s, ({NOW} - CAST(floor(epoch(ts)) AS BIGINT)) // (event_id % 997 + 1) AS age FROM events)
SELECT event_id, strftime(ts, '%m-%d %H:%M') AS minute, strftime(ts, '%H:%M:%S') AS clock, 'later' AS no_clock,
  CASE WHEN age >= 86400 THEN concat(CAST(age // 86400 AS VARCHAR), 'd') WHEN age >= 3600 THEN concat(CAST(age // 3600 AS VARCHAR), 'h')
    WHEN age >= 60 THEN concat(CAST(age // 60 AS VARCHAR), 'm') ELSE concat(CAST(age AS VARCHAR), 's') END AS age,
  strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S.250+00:00') AS iso, format('{{:,}}', s) AS grouped FROM e""",
    "path_labels": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?:/(/.*)$', 1) AS path FROM pages),
q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
r AS (SELECT *, concat(array_to_string(list_transform(parts[1:len(parts) - 1], lambda x: concat(left(x, 1), '/')), ''), parts[len(parts)]) AS tail FROM q)
SELECT page_id, concat('/', tail) AS short, tail AS short_relative, replace(path, '/', '-') AS encoded,
  CASE WHEN length(url) <= 20 THEN url ELSE concat(left(url, 19), '…') END AS cut FROM r""",
}
