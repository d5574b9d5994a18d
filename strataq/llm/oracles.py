"""DuckDB SQL for those queries of this subpackage that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, (SELECT unnest(range(13)) AS j)),
word AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Costs of the cheapest ways to the states system (1), user (2) and assistant (3) forwards, then the way backwards. Of
#: conversations with a number for every turn and none twice.
OP2 = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '<||') AS t, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  coalesce(list_position(['system', 'user', 'assistant'], lower(trim(role))), 0) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CASE WHEN s = 1 THEN 0 ELSE 3 END AS r1, CASE WHEN s = 2 THEN 0 ELSE 3 END AS r2, CASE WHEN s = 3 THEN 0 ELSE 3 END AS r3 FROM o),
fw AS (SELECT conv_id, i, n, r1 AS c1, r2 AS c2, 2 + r3 AS c3 FROM r WHERE i = 1 UNION ALL
  SELECT r.conv_id, r.i, r.n, c1 + 1 + r1, least(c1, c2 + 1, c3) + r2, least(c1 + 2, c2, c3 + 1) + r3 FROM fw JOIN r ON r.conv_id = fw.conv_id AND r.i = fw.i + 1),
ends AS (SELECT conv_id, i, least(c1 + 4, c2 + 2, c3) AS cost, CASE WHEN c1 + 4 <= least(c2 + 2, c3) THEN 1 WHEN c2 + 2 <= c3 THEN 2 ELSE 3 END AS q FROM fw WHERE i = n),
bw AS (SELECT conv_id, i, q FROM ends UNION ALL
  SELECT fw.conv_id, fw.i, CASE q WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN c1 <= least(c2 + 1, c3) THEN 1 WHEN c2 + 1 <= c3 THEN 2 ELSE 3 END ELSE CASE WHEN c1 + 2 <= least(c2, c3 + 1) THEN 1 WHEN c2 <= c3 + 1 THEN 2 ELSE 3 END END
  FROM bw JOIN fw ON fw.conv_id = bw.conv_id AND fw.i = bw.i - 1),
p AS (SELECT r.*, bw.q, coalesce(lag(bw.q) OVER (PARTITION BY r.conv_id ORDER BY r.i), 0) AS p, cost FROM r JOIN bw ON bw.conv_id = r.conv_id AND bw.i = r.i JOIN ends ON ends.conv_id = r.conv_id),
x AS (SELECT *, p = q AS merged, p < 2 AND q = 3 AS put, chr(10) || '<|end|>' || chr(10) AS z, chr(10) AS l FROM p)
SELECT conv_id, turn::BIGINT AS turn, role, ['system', 'user', 'assistant'][q] AS new_role, q <> s AS relabelled, merged, cost::BIGINT AS cost,
array_to_string(list_filter([CASE WHEN put THEN 'user' END, CASE WHEN i = n AND q = 1 THEN 'user' END, CASE WHEN i = n AND q < 3 THEN 'assistant' END], lambda v: v IS NOT NULL), ',') AS inserted,
concat(CASE WHEN p = 0 THEN '' WHEN merged THEN l ELSE z END, CASE WHEN put THEN '<|user|>' || l || z END, CASE WHEN NOT merged THEN '<|' || ['system', 'user', 'assistant'][q] || '|>' || l END, t,
  CASE WHEN i = n THEN z END, CASE WHEN i = n AND q = 1 THEN '<|user|>' || l || z END, CASE WHEN i = n AND q < 3 THEN '<|assistant|>' || l || z END) AS rendered
FROM x
"""

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
it AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 5),
ig AS (SELECT item_id, n, o, array_to_string(w[o + 1:o + 5], ' ') AS g FROM (SELECT *, unnest(range(0, n - 4)) AS o FROM it)),
dg AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
hit AS (SELECT DISTINCT doc_id, item_id, n, p, len(w) AS of FROM dg JOIN (SELECT DISTINCT item_id, n, g FROM ig) USING (g) JOIN d USING (doc_id)),
win AS (SELECT DISTINCT doc_id, item_id, n, of, unnest(range(greatest(0, p - n + 5), greatest(0, least(p, of - n)) + 1)) AS start FROM hit),
wg AS (SELECT win.doc_id, item_id, start, n, of, g, count(*) AS c FROM win JOIN dg ON dg.doc_id = win.doc_id AND p BETWEEN start AND start + n - 5 GROUP BY ALL),
gi AS (SELECT item_id, g, count(*) AS c FROM ig GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, n, of, sum(least(wg.c, gi.c)) AS i FROM wg JOIN gi USING (item_id, g) GROUP BY ALL),
ok AS (SELECT doc_id, item_id, start, i / (least(n, of - start) - 4 + n - 4 - i)::DOUBLE AS similarity FROM sim)
SELECT doc_id, item_id, start::BIGINT AS start, similarity FROM ok WHERE similarity >= 0.8 - 1e-9 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, bit_xor(hash(g)) AS k FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b, x.k AS ka, y.k AS kb FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
few AS (SELECT a AS doc_id, count(DISTINCT kb) AS n_links FROM link WHERE ka <> kb GROUP BY 1)
SELECT doc_id, min(r) AS class_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links FROM reach LEFT JOIN few USING (doc_id) GROUP BY 1
"""

OP6 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols * 1000000 // word_chars ELSE 0 END AS v1, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END AS v2,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000000 // n_words ELSE 0 END AS v3, CASE WHEN n_words > 0 THEN word_chars * 1000000 // n_words ELSE 0 END AS v4 FROM m),
e AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([v1, v2, v3, v4]) AS v FROM b WHERE NOT base_failed),
sk AS (SELECT lang, source, k, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin, count(*) AS n FROM e GROUP BY ALL),
lv AS (SELECT 0 AS level, NULL AS lang, NULL AS source, k, bin, n FROM sk UNION ALL SELECT 1, lang, NULL, k, bin, n FROM sk UNION ALL SELECT 2, lang, source, k, bin, n FROM sk),
up AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, k) AS al FROM (SELECT level, lang, source, k, bin, sum(n) AS n FROM lv GROUP BY ALL)),
q AS (SELECT level, lang, source, k, al, 2 * (tail + (1::BIGINT << greatest(length(bin(tail)) - 6, 0)) - 1) - middle AS own FROM (SELECT level, lang, source, k, max(al) AS al, min(bin) FILTER (upto * 100 >= al * [95, 99, 99, 95][k]) AS tail, min(bin) FILTER (upto * 2 >= al) AS middle FROM up GROUP BY 1, 2, 3, 4)),
c0 AS (SELECT k, nullif(own, 0) AS c FROM q WHERE level = 0),
c1 AS (SELECT k, lang, CASE WHEN al < 200 THEN c WHEN c IS NULL THEN nullif(own, 0) ELSE least(coalesce(nullif(own, 0), c), 2 * c) END AS c FROM q JOIN c0 USING (k) WHERE level = 1),
c2 AS (SELECT q.k, q.lang, source, CASE WHEN al < 200 THEN c WHEN c IS NULL THEN nullif(own, 0) ELSE least(coalesce(nullif(own, 0), c), 2 * c) END AS c FROM q JOIN c1 ON c1.k = q.k AND c1.lang IS NOT DISTINCT FROM q.lang WHERE level = 2),
f AS (SELECT lang, source, max(c) FILTER (k = 1) AS f1, max(c) FILTER (k = 2) AS f2, max(c) FILTER (k = 3) AS f3, max(c) FILTER (k = 4) AS f4 FROM c2 GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(v1 > f1, false) OR coalesce(v2 > f2, false) OR coalesce(v3 > f3, false) OR coalesce(v4 > f4, false)) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""

#: CRC-32 from its rule, byte by byte, of each distinct feature.
OP12 = r"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
x AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
g AS (SELECT side, id, array_to_string(w[i:i + k], ' ') AS g FROM (SELECT side, id, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([0, 1, 2]) AS k) WHERE len(w) > k)),
c AS MATERIALIZED (SELECT side, id, g, count(*) AS c FROM g GROUP BY ALL),
b AS MATERIALIZED (SELECT g, xor(list_reduce(list_transform(range(strlen(g)), lambda i: ('0x' || substr(hex(encode(g)), (2 * i + 1)::INT, 2))::BIGINT), lambda s, v: xor(tab[(1 + xor(s, v) % 256)::INT], s // 256), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT g FROM c), tab),
n AS (SELECT b, coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side = 1), 0) AS t FROM c JOIN b USING (g) GROUP BY 1),
a AS (SELECT sum(s) AS ss, sum(t) AS tt FROM n),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM n, a),
d AS (SELECT id, sum(c) AS n, sum(c * gain) AS weight FROM c JOIN b USING (g) JOIN gain USING (b) WHERE side = 0 GROUP BY 1),
o AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d USING (id) WHERE side = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS of FROM o WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * of // 100 THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id)
"""

ORACLES = {"op1_substring_dedup": OP1, "op2_chat_formatting": OP2, "op3_decontamination": OP3, "op5_jaccard_join": OP5, "op6_quality_rules": OP6, "op8_warc": OP8, "op12_importance_resampling": OP12}
