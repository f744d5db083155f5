"""DuckDB SQL for those queries whose results SQL can express, by brute force."""

from __future__ import annotations

from graphlaw.llm.decontaminate import AGREE, LEAST_TOKENS, SHARE

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Equal tokens of documents and items, counted along each diagonal.
OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_TOKENS} AS h FROM documents),
b AS (SELECT item_id, row_number() OVER () AS bid, {_TOKENS} AS t FROM benchmark),
dt AS (SELECT rid, unnest(h) AS w, unnest(range(len(h))) AS i FROM d),
bt AS (SELECT item_id, bid, len(t) AS n, unnest(t) AS w, unnest(range(len(t))) AS j FROM b WHERE len(t) >= {LEAST_TOKENS}),
hit AS (SELECT rid, item_id FROM dt JOIN bt USING (w) GROUP BY rid, item_id, bid, n, i - j HAVING count(*) >= least({AGREE}, ceil({SHARE} * n - 1e-9))),
leak AS (SELECT rid, list_sort(list(DISTINCT item_id)) AS item_ids FROM hit GROUP BY rid)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids FROM d LEFT JOIN leak USING (rid)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS ws FROM documents),
win AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
bad AS (SELECT rid, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, i + unnest(range(35)) AS p FROM bad),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

#: Bytes are pairs of hexadecimal digits here.
OP8 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
head AS (SELECT k, min((doc_id, i)) AS f FROM win GROUP BY k HAVING count(*) > 1),
bad AS (SELECT doc_id, i FROM win JOIN head USING (k) WHERE (doc_id, i) > f),
edge AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM bad),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS s, max(i) + 100 AS e FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS after, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS follow FROM span),
piece AS (SELECT doc_id, string_agg(substr(h, 2 * after + 1, 2 * (s - after)), '' ORDER BY s) AS body, max(e) AS last, sum(e - s) AS n, count(*) AS c FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, strlen(t)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(body || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN piece USING (doc_id)
"""

#: Every pair that shares a shingle, bags of them compared by the least counts, and the components of those that are alike.
OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, md5(coalesce(text, '')) AS k, {_WORDS} AS ws FROM documents),
t AS (SELECT k, any_value(ws) AS ws, min(doc_id) AS m FROM d GROUP BY k),
s AS (SELECT k, md5(array_to_string(ws[i:i + 4], ' ')) AS g, count(*) AS m FROM (SELECT k, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM t WHERE len(ws) > 0) GROUP BY 1, 2),
n AS (SELECT k, sum(m) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, sum(least(a.m, b.m)) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT k, k AS r FROM t UNION SELECT reach.k, link.b FROM reach JOIN link ON reach.r = link.a),
root AS (SELECT k, min(r) AS root FROM reach GROUP BY k),
size AS (SELECT root, min(doc_id) AS class_id, count(*) AS class_rows, count(DISTINCT k) AS class_texts FROM d JOIN root USING (k) GROUP BY root)
SELECT doc_id, class_id, class_rows, class_texts FROM d JOIN root USING (k) JOIN size USING (root)
"""

SQL = {"op2_spaced_seed_decontamination": OP2, "op5_substring_dedup": OP5, "op8_suffix_dedup": OP8, "op10_dart_minhash": OP10}
