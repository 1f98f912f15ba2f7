"""DuckDB SQL of the queries that SQL can express.

Not here, and tested against brute force instead: fingerprints (XXH64), the trained models, the encoder and the
token counts.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT r, vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0
), link AS (
  SELECT a.r AS x, b.r AS y FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.u) = len(b.u)
  WHERE list_dot_product(a.u, b.u) >= 0.98
), reach(x, y) AS (
  SELECT r, r FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), component AS (
  SELECT reach.x AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x
), degree AS (SELECT x AS r, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN component USING (r) LEFT JOIN degree USING (r)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT payload, max(page_id) AS winner FROM p GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM p JOIN w USING (payload)
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), need AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS phrase
  FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM need),
have AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM d, lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s) WHERE len(w) >= n
), hit AS (SELECT r, have.n, s, item FROM have JOIN need ON have.n = need.n AND have.phrase = need.phrase),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS named FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(named, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def _draws(name: str, tree: str) -> str:
    """The three draws on the way down a tree of (shard, region, rack) rows of equal weight."""
    draw = "-ln((('0x' || substr(md5(k || '/' || node), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / weight"
    return f"""
{name}_region AS (
  SELECT r, k, arg_min(region, {draw}) AS region FROM d,
    (SELECT region, 'r' || region AS node, count(*)::DOUBLE AS weight FROM {tree} GROUP BY region) GROUP BY r, k
), {name}_rack AS (
  SELECT r, k, region, arg_min(rack, {draw}) AS rack FROM {name}_region JOIN
    (SELECT region, rack, 'r' || region || '/k' || rack AS node, count(*)::DOUBLE AS weight FROM {tree} GROUP BY region, rack)
    USING (region) GROUP BY r, k, region
), {name} AS (
  SELECT r, arg_min(shard, {draw}) AS shard FROM {name}_rack JOIN
    (SELECT region, rack, shard, 'r' || region || '/k' || rack || '/s' || shard AS node, 1.0 AS weight FROM {tree})
    USING (region, rack) GROUP BY r
)"""


SHARDING = f"""
WITH tree AS (SELECT s AS shard, s // 4 AS region, s % 4 // 2 AS rack FROM range(16) x(s)),
more AS (SELECT * FROM tree UNION ALL SELECT 16, 4, 0),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS text FROM documents
), crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) x(i))
), sums AS (
  SELECT r, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, crc
), {_draws("old", "tree")}, {_draws("new", "more")}
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, text_crc32, 'key' AS law, old.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY old.shard ORDER BY doc_id NULLS FIRST, r) - 1 AS slot, new.shard::INTEGER AS grown_shard
FROM d JOIN sums USING (r) JOIN old USING (r) JOIN new USING (r)
"""

#: (fields, choice of those that must be equal) where not all must.
_CHOICES = ", ".join(
    f"({k}, {list(c)})" for k in range(1, 9) for c in combinations(range(1, k + 1), ceil(0.75 * k)) if len(c) < k
)

LINES = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, text,
    string_split(text, chr(10)) AS ls FROM documents
), l AS (SELECT r, doc, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
t AS (
  SELECT r, doc, i, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'),
    lambda w: CASE WHEN regexp_matches(w, '[0-9@]|://') THEN '<*>' ELSE w END) AS w FROM l
), e AS (
  SELECT r, doc, i, w, len(w) AS n, w[1:3] AS head, least(len(w) - 3, 8) AS k,
    list_transform(range(least(len(w) - 3, 8)), lambda j: w[4 + (len(w) - 3) * j // least(len(w) - 3, 8) : 3 + (len(w) - 3) * (j + 1) // least(len(w) - 3, 8)]) AS f
  FROM t WHERE len(w) >= 3
), place AS (
  SELECT r, doc, i, n, 'whole' AS kind, NULL AS choice, [w] AS parts FROM e
  UNION ALL SELECT r, doc, i, n, 'fields', choice, [head] || list_select(f, choice) FROM e JOIN (VALUES {_CHOICES}) c(k, choice) USING (k)
  UNION ALL SELECT r, doc, i, n, 'leading', choice, [list_select(head, choice), w[4:]] FROM e, (VALUES ([2, 3]), ([1, 3]), ([1, 2])) c(choice) WHERE k > 0
), template AS (
  SELECT n, kind, choice, parts, min(doc) AS first FROM place GROUP BY n, kind, choice, parts
  HAVING count(DISTINCT r) >= CASE WHEN n < 8 THEN 10 ELSE 2 END AND min(doc) <> max(doc)
), gone AS (
  SELECT DISTINCT r, i FROM place p JOIN template t ON p.n = t.n AND p.kind = t.kind AND p.parts = t.parts
    AND p.choice IS NOT DISTINCT FROM t.choice WHERE doc <> first
), left_over AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (NOT g) AS text, count(*) AS n_lines, count(*) FILTER (g) AS n_dropped
  FROM (SELECT l.*, gone.r IS NOT NULL AS g FROM l LEFT JOIN gone USING (r, i)) GROUP BY r
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN coalesce(left_over.text, '') END AS text
FROM d LEFT JOIN left_over USING (r)
"""

FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), draw AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draw
), part AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
    AS output_sha256, sha256(t) AS restored_sha256
FROM part
"""

STATEMENTS: dict[str, str] = {
    "op3_embeddings": EMBEDDINGS, "op5_warc": WARC, "op7_decontamination": DECONTAMINATION, "op9_sharding": SHARDING,
    "op10_line_dedup": LINES, "op11_fill_in_middle": FILL_IN_MIDDLE,
}
