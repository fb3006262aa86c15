"""SQL with the same rows as the queries, where SQL can express them."""

from sessionmeter.llm import license_scan

# base32 of a SHA-1: 5 hexadecimal digits make 4 of base 32
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT >> {15 - 5 * j}) & 31)::INTEGER, 1)"
    for k in range(8)
    for j in range(4)
)

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""

_TERM = "[a-z0-9]+(?:\\.[a-z0-9]+)*"

_TEMPLATES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(license_scan.TEMPLATES + license_scan.TEXTS))

OP6 = f"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id,
    source || '/' || (doc_id // 100)::VARCHAR || '/' || doc_id::VARCHAR || '.txt' AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM f),
tt AS (SELECT k, name, t, count(*) AS tf FROM (SELECT k, name, unnest(regexp_extract_all(lower(txt), '{_TERM}')) AS t
    FROM (VALUES {_TEMPLATES}) v(k, name, txt)) GROUP BY ALL),
df AS (SELECT t, count(*) AS c FROM (SELECT r, unnest(list_distinct(regexp_extract_all(lower(text), '{_TERM}'))) AS t FROM f) GROUP BY t),
voc AS (SELECT DISTINCT t, ln((1 + (SELECT n FROM n)) / (1 + coalesce(c, 0))) + 1 AS idf FROM tt LEFT JOIN df USING (t)),
tv AS (SELECT tt.k AS template, name, t, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY tt.k)) AS unit FROM tt JOIN voc USING (t)),
u AS (SELECT r, len(regexp_extract_all(lower(text), '{_TERM}')) AS size,
    list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')), [text]) AS parts FROM f),
l0 AS (SELECT r, size, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM u),
l1 AS (SELECT r, size, k, t, count(*) AS tf FROM (SELECT r, size, k, unnest(regexp_extract_all(lower(line), '{_TERM}')) AS t FROM l0) GROUP BY ALL),
l2 AS (SELECT l1.*, tf * coalesce(idf, ln(1 + (SELECT n FROM n)) + 1) AS w FROM l1 LEFT JOIN voc USING (t)),
norms AS (SELECT r, k, sqrt(sum(w * w)) AS norm, sum(tf) AS held, max(size) AS size FROM l2 GROUP BY r, k),
dots AS (SELECT r, k, template, name, sum(w * unit) AS dot FROM l2 JOIN tv USING (t) GROUP BY r, k, template, name),
reach AS (SELECT r, name, k, round(dot / norm, 6) AS cosine, max(held >= {license_scan.LEAST_SHARE} * size) OVER (PARTITION BY r, name) AS is_file
    FROM dots JOIN norms USING (r, k) WHERE round(dot / norm, 6) >= {license_scan.LEAST_COSINE}),
best AS (SELECT r, name, cosine, is_file, row_number() OVER (PARTITION BY r ORDER BY cosine DESC, k, name) AS place FROM reach),
own AS (SELECT f.r, doc_id, path, name AS own_licence, cosine, is_file FROM f LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (r)),
given AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, own_licence,
    row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY cosine DESC, own_licence) AS place FROM own WHERE is_file),
up AS (SELECT r, d, unnest([path[:0], split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS directory,
    unnest([0, 1, 2]) AS depth FROM (SELECT r, path, 1 AS d FROM own WHERE own_licence IS NULL AND path IS NOT NULL)),
near AS (SELECT r, directory AS licence_from, own_licence AS given, row_number() OVER (PARTITION BY r ORDER BY depth DESC) AS place
    FROM up JOIN (SELECT * FROM given WHERE place = 1) g USING (directory))
SELECT doc_id, path, own.own_licence, cosine, coalesce(own.own_licence, given) AS licence, licence_from
FROM own LEFT JOIN (SELECT * FROM near WHERE place = 1) x USING (r)
"""

ORACLE: dict[str, str] = {"op2_warc": OP2, "op6_license_scan": OP6}
