"""DuckDB SQL of the operators that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.a = doc_id
"""

LINE_DEDUP = r"""
WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS pos FROM p),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, first IS NOT NULL AND first <> doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

SOURCE_MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(place - 1) % 3 + 1]::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap FROM n),
r AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, place) AS pos FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, pos) FROM v WHERE level <= ratio) * weight) AS target FROM v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
m AS (SELECT *, target - whole * source_size AS missing FROM g),
x AS (SELECT source, size, h, unnest(range(10)) AS draw FROM d),
y AS (SELECT source, draw, size, (instr('0123456789abcdef', h[3 * draw + 1]) - 1) * 256 + (instr('0123456789abcdef', h[3 * draw + 2]) - 1) * 16
  + instr('0123456789abcdef', h[3 * draw + 3]) - 1 AS step FROM x),
z AS (SELECT source, draw, step, sum(sum(size)) OVER (PARTITION BY source, draw ORDER BY step) AS upto FROM y GROUP BY source, draw, step),
b AS (SELECT m.source, source_size, target, whole, missing, min({{'off': abs(upto - missing), 'draw': draw, 'steps': step + 1}}) AS best
  FROM z JOIN m ON z.source IS NOT DISTINCT FROM m.source GROUP BY ALL),
f AS (SELECT *, CASE WHEN missing <= best.off THEN 0 ELSE best.steps END AS steps, best.draw AS draw FROM b)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN (instr('0123456789abcdef', h[3 * draw + 1]) - 1) * 256
  + (instr('0123456789abcdef', h[3 * draw + 2]) - 1) * 16 + instr('0123456789abcdef', h[3 * draw + 3]) - 1 < steps THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""
