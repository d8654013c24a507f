"""DuckDB SQL for the queries that SQL can express."""

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day,
  lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*/([^/?#]+)', 1) AS seg FROM pages),
n0 AS (SELECT DISTINCT host AS rule, 3 AS part FROM c WHERE host != '' UNION SELECT DISTINCT host || '/' || lower(seg), 4 FROM c WHERE host != '' AND seg != ''),
n1 AS (SELECT rule, part, ('0x' || substr(md5(rule), 1, 4))::INT a, ('0x' || substr(md5(rule), 5, 4))::INT b, ('0x' || substr(md5(rule), 9, 4))::INT c, ('0x' || substr(md5(rule), 13, 4))::INT d FROM n0),
n AS (SELECT *, CASE WHEN part = 4 AND d % 3 = 0 THEN 'allow' ELSE 'block' END AS kind, ['adult', 'malware', 'spam'][c % 3 + 1] AS category FROM n1 WHERE (part = 3 AND a % 3 < 2) OR (part = 4 AND a % 4 = 0)),
s AS (SELECT rule, kind, category, 'add' AS action, DATE '2024-01-01' + (b % 200) AS day FROM n
  UNION ALL SELECT rule, kind, category, 'remove', DATE '2024-01-01' + (b % 200 + 20 + c % 100) FROM n WHERE c % 5 != 0
  UNION ALL SELECT rule, kind, category, 'add', DATE '2024-01-01' + (b % 200 + 130 + d % 60) FROM n WHERE c % 5 != 0 AND d % 2 = 0),
i0 AS (SELECT *, row_number() OVER (PARTITION BY rule, day ORDER BY action DESC) r FROM s),
i AS (SELECT *, lead(day) OVER (PARTITION BY rule ORDER BY day) AS until FROM i0 WHERE r = 1),
m AS (SELECT c.page_id, i.rule, i.category, i.kind, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.rule) DESC, i.rule) r
  FROM c JOIN i ON i.action = 'add' AND c.host != '' AND i.day <= c.day AND (i.until IS NULL OR c.day < i.until)
   AND (c.host = i.rule OR ends_with(c.host, '.' || i.rule) OR (c.seg != '' AND (c.host || '/' || lower(c.seg) = i.rule OR ends_with(c.host || '/' || lower(c.seg), '.' || i.rule)))))
SELECT c.page_id, c.url, c.host, CAST(c.day AS VARCHAR) AS fetched_on, m.rule, m.category, coalesce(m.kind = 'block', false) AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1
"""

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
   ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
k AS (SELECT doc_id, len(s) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT i.a, i.b FROM i JOIN k ka ON ka.doc_id = i.a JOIN k kb ON kb.doc_id = i.b WHERE 100 * inter >= 80 * (ka.n + kb.n - inter)),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS c FROM k UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.node)
SELECT k.doc_id, k.n AS n_shingles, min(r.c) AS component_id, k.doc_id = min(r.c) AS kept FROM k JOIN r ON r.node = k.doc_id GROUP BY k.doc_id, k.n
"""

#: A source is full where the budget left for it and those after it, in order of size to weight, gives it more than twice its size.
MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS u FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
o AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, [0.0, 0.6, -0.6][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS ramp FROM s),
f AS (SELECT *, coalesce(sum(2 * n) OVER p, 0) AS full_before, sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, sum(n) OVER () AS total FROM o
  WINDOW p AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (1.5 * total - full_before) * w / w_left > 2 * n AS is_full, (1.5 * total - full_before) / w_left AS rate FROM f),
t AS (SELECT source, n, ramp, CASE WHEN is_full THEN 2.0 * n ELSE w * (SELECT min_by(rate, n / w) FROM h WHERE NOT is_full) END::DOUBLE AS target FROM h),
a AS (SELECT d.*, t.n, t.ramp, t.target, round(t.target)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, CASE WHEN n > 0 THEN goal // n ELSE 0 END AS whole FROM a),
x AS (SELECT *, greatest(0, least(size, goal - whole * n - pos)) AS rest FROM b),
y AS (SELECT *, CASE WHEN size > 0 THEN whole + (rest > 0)::INT ELSE 0 END AS copies FROM x)
SELECT doc_id, size::BIGINT AS size, n AS source_size, round(target, 3) AS target, (whole * size + rest)::BIGINT AS taken, copies::BIGINT AS n_copies,
  CASE WHEN copies > 0 THEN round((pos / greatest(goal, 1)) / ((1 - ramp) / 2 + sqrt((1 - ramp) / 2 * ((1 - ramp) / 2) + ramp * (pos / greatest(goal, 1)))), 6)::DOUBLE END AS first_position
FROM y
"""
OP8 = MIX.replace("{docs}", "documents")

OP9 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept, count(c.p) AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.gone, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

OP10 = f"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM x),
k AS (SELECT *, translate(trim(line, {SPACE}), {LOWER}) AS key FROM l),
g AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(g.key)::BIGINT AS n_dropped, sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY k.doc_id
"""

ORACLES = {
    "op1_url_filters": OP1,
    "op3_minhash_near_dedup": OP3,
    "op8_source_mixing": OP8,
    "op9_substring_dedup": OP9,
    "op10_line_dedup": OP10,
}
