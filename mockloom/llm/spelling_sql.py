"""DuckDB SQL of spelling variants."""

from mockloom.llm.manifest_sql import crc32

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
o AS (SELECT run, count(*) AS c, coalesce(doc_id::VARCHAR, 'null') || ':' || run AS seed FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, c, {crc32('seed')} AS h FROM o),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
y AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM x),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM y a JOIN y b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT y.word, v.word, v.n FROM y JOIN v ON y.less = v.word UNION SELECT v.word, y.word, y.n FROM y JOIN v ON y.less = v.word),
b AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': encode(near)}}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN decode(best.near) END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n
  FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root FROM f UNION SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON f.word = c.word JOIN f l ON l.word = c.root WHERE l.form IS NULL
"""
