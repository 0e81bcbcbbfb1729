"""SQL (DuckDB) that gives the rows of those queries that SQL can express. It compares all with all and suits small tables only."""

from __future__ import annotations

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOW}')"

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM iw),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
hit AS (SELECT dw.doc_id, dw.n, dw.p, win.item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
pos AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.a = c.component_id AS kept FROM c LEFT JOIN n ON c.a = n.a"""


MIXING = rf"""
WITH RECURSIVE b AS (SELECT doc_id, source, coalesce(md5(text), '') AS h, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM per),
lv AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r FROM w),
f AS (SELECT *, min(CASE WHEN unit * weight <= cap THEN r END) OVER () AS r0 FROM lv),
g AS (SELECT *, max(CASE WHEN r = r0 THEN unit END) OVER () AS water FROM f),
t AS (SELECT source, source_size, CASE WHEN r >= r0 THEN least(cap, water * weight) ELSE cap END AS target FROM g),
bw AS (SELECT *, CAST(length(bin(size)) AS DOUBLE) AS w FROM b),
ms AS (SELECT bw.source, bw.w, max(t.target) AS target, CAST(sum(size) AS BIGINT) AS words FROM bw JOIN t ON bw.source IS NOT DISTINCT FROM t.source GROUP BY bw.source, bw.w),
le AS (SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(w * words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM ms),
op AS (SELECT *, max(CASE WHEN level * w <= 2 THEN w END) OVER (PARTITION BY source) AS ow FROM le),
ol AS (SELECT *, max(CASE WHEN w = ow THEN level END) OVER (PARTITION BY source) AS level0 FROM op),
ra AS (SELECT source, w, words, target, CASE WHEN NOT target > 0 THEN 0.0::DOUBLE WHEN w <= ow THEN greatest(0.0::DOUBLE, level0 * w) ELSE 2.0::DOUBLE END AS rate FROM ol),
rw AS (SELECT *, CAST(floor(rate + 1e-12::DOUBLE) AS BIGINT) AS whole FROM ra),
q AS (SELECT source, CAST(greatest(0, floor(max(target) + 0.5::DOUBLE) - sum(whole * words)) AS BIGINT) AS quota, CAST(floor(max(target) * 0.005::DOUBLE) AS BIGINT) AS slack FROM rw GROUP BY source),
pr AS (SELECT bw.*, t.source_size, t.target, rw.whole, greatest(0.0::DOUBLE, rw.rate - rw.whole) AS p, (CAST(CAST('0x' || substr(md5('1' || chr(31) || CAST(bw.doc_id AS VARCHAR) || chr(31) || h), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM bw JOIN t ON bw.source IS NOT DISTINCT FROM t.source JOIN rw ON bw.source IS NOT DISTINCT FROM rw.source AND bw.w = rw.w),
od AS (SELECT *, CASE WHEN p > 1e-12::DOUBLE AND size > 0 THEN u / (1 - u) * (1 - p) / p END AS odds FROM pr),
l AS (SELECT o.source, o.doc_id, o.h, o.size, q.quota, q.slack, o.odds / (1 + o.odds) AS s FROM od o JOIN q ON o.source IS NOT DISTINCT FROM q.source WHERE o.odds IS NOT NULL),
cu AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY s, doc_id, h) AS upto FROM l),
k1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s, doc_id, h) AS n FROM cu WHERE upto > quota),
gp AS (SELECT source, quota - upto + size AS gap FROM k1 WHERE n = 1),
ca AS (SELECT k1.*, gp.gap, row_number() OVER (PARTITION BY k1.source ORDER BY s, doc_id, h) AS r FROM k1 JOIN gp ON k1.source IS NOT DISTINCT FROM gp.source WHERE size <= gap AND gap > slack),
gr AS (SELECT source, CAST(0 AS BIGINT) AS r, CAST(gap AS BIGINT) AS rest, false AS got FROM gp UNION ALL SELECT gr.source, ca.r, CAST(CASE WHEN ca.size <= gr.rest AND gr.rest > ca.slack THEN gr.rest - ca.size ELSE gr.rest END AS BIGINT), ca.size <= gr.rest AND gr.rest > ca.slack FROM gr JOIN ca ON gr.source IS NOT DISTINCT FROM ca.source AND ca.r = gr.r + 1 WHERE ca.r <= 200),
y AS (SELECT doc_id, h FROM cu WHERE upto <= quota UNION ALL SELECT ca.doc_id, ca.h FROM ca JOIN gr ON ca.source IS NOT DISTINCT FROM gr.source AND ca.r = gr.r WHERE gr.got)
SELECT pr.doc_id, pr.size, pr.source_size, pr.target, CAST(pr.size * (pr.whole + CASE WHEN y.doc_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken FROM pr LEFT JOIN y ON pr.doc_id = y.doc_id AND pr.h = y.h"""

MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM p),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x.a, x.b FROM x JOIN c ca ON x.a = ca.doc_id JOIN c cb ON x.b = cb.doc_id WHERE 100 * k >= 85 * (ca.n + cb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT m.a AS doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, m.a = m.component_id AS kept FROM m LEFT JOIN c ON m.a = c.doc_id"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {5 * (3 - k)}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for k in range(4))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN p.page_id = g.top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id = g.top THEN NULL ELSE g.top END AS refers_to FROM p JOIN g USING (h)"""

ORACLE_SQL = {"op3_decontaminate": DECONTAMINATE, "op4_embedding_dedup": EMBEDDINGS, "op5_mixing": MIXING, "op6_minhash": MINHASH, "op7_warc": WARC}
