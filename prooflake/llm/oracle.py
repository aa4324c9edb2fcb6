"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .license_scan import PERCENT, TEMPLATES, block_words, template_words

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS g FROM w
), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s
), e AS (SELECT doc_id, unnest(g) AS x FROM s
), pairs AS (
  SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT p, q FROM pairs JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q
  WHERE 100 * common >= 75 * (a.n_shingles + b.n_shingles - common)
), edges AS (SELECT p, q FROM links UNION SELECT q, p FROM links
), reach AS (
  SELECT p, q FROM edges UNION SELECT reach.p, edges.q FROM reach JOIN edges ON reach.q = edges.p
)
SELECT n.doc_id, n_shingles, CAST(least(n.doc_id, coalesce((SELECT min(q) FROM reach WHERE reach.p = n.doc_id), n.doc_id)) AS BIGINT) AS component_id FROM n
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT page_id, h, first, array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(x, i, 1))] FOR i IN range(1, 41)], '') AS bits FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM b
"""

TOP_K = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS y FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.y[i] * c.y[i] FOR i IN range(1, len(q.y) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM r WHERE k <= 5
"""

_T = ", ".join(f"('{k}', [{', '.join(f"'{w}'" for w in template_words(t))}])" for k, t in TEMPLATES.items())
_N = block_words(TEMPLATES)
_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LICENSES = rf"""
WITH t(label, ws) AS (VALUES {_T}),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_W}') AS ws FROM d),
p AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    [i FOR i IN range(0, len(ws)) IF ws[i + 1] = 'cc' AND ws[i + 2] = 'by'] AS cc,
    [i FOR i IN range(0, len(ws)) IF ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license'] AS gpl,
    [i FOR i IN range(0, len(ws)) IF ws[i + 1] = 'all' AND ws[i + 2] = 'rights' AND ws[i + 3] = 'reserved'] AS res
  FROM w
), lw AS (SELECT doc_id, list_distinct(unnest([ws[{_N} * i + 1 : {_N} * i + 2 * {_N}] FOR i IN range(0, greatest(1, CAST(ceil(len(ws) / {_N}.0) AS BIGINT) - 1))])) AS ws FROM w
), hits AS (
  SELECT doc_id, label, max(len(list_intersect(t.ws, lw.ws)) / CAST(len(t.ws) AS DOUBLE)) AS c FROM lw, t
  WHERE 100 * len(list_intersect(t.ws, lw.ws)) >= {PERCENT} * len(t.ws) GROUP BY ALL
), h AS (SELECT doc_id, list(label) AS ls, max(c) AS c FROM hits GROUP BY doc_id
), b AS (
  SELECT p.*, list_concat(list_concat(cc, gpl), res) AS places,
    list_concat(list_concat(CASE WHEN len(cc) > 0 THEN ['cc-by'] ELSE [] END, CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END), CASE WHEN len(res) > 0 THEN ['reserved'] ELSE [] END) AS bl
  FROM p
)
SELECT b.doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(ls, [])))), ',') AS labels,
  CASE WHEN len(bl) > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(c, CAST(0 AS DOUBLE)) END AS score
FROM b LEFT JOIN h ON b.doc_id = h.doc_id
"""

LINE_DEDUP = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), r AS (SELECT k.*, holder IS NULL OR doc_id = holder AS stays FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256 FROM r GROUP BY doc_id
"""

RESAMPLE = rf"""
WITH tab AS (SELECT [list_reduce(list_concat([CAST(i AS BIGINT)], [CAST(k AS BIGINT) FOR k IN range(8)]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t
), dw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_W}')) AS w FROM documents
), bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_W}')) AS w FROM benchmark
), dc AS (SELECT doc_id, w, count(*) AS n FROM dw GROUP BY ALL
), v AS (SELECT DISTINCT w FROM (SELECT w FROM dc UNION ALL SELECT w FROM bw)
), h AS (SELECT w, hex(encode(w)) AS x FROM v
), b AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], [CAST(('0x' || substr(x, 2 * i - 1, 2)) AS BIGINT) FOR i IN range(1, len(x) // 2 + 1)]),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab
), s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM dc JOIN b USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (w) GROUP BY bucket
), a AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) AS ss, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) AS tt
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * (ss + 10000) / ((coalesce(s, 0) + CAST(1 AS DOUBLE)) * (tt + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), a
), w AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM dc JOIN b USING (w) JOIN g USING (bucket) GROUP BY doc_id
), z AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) AS h FROM documents LEFT JOIN w USING (doc_id)
), x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM z
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM x WHERE n_features >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN k <= 10 * (SELECT count(*) FROM r) // 100 THEN k END AS rank FROM x LEFT JOIN r USING (doc_id)
"""
