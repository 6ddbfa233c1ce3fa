"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op3_decontaminate"] = r"""
WITH item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hit AS (
  SELECT r, i, p.n, iw.item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM pos) p JOIN iw USING (n, win)),
hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

ORACLES["op4_pareto_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
m AS (
  SELECT *, CASE WHEN size < 32 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    (('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key
  FROM d),
s AS (SELECT key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY key) - 1 AS nth FROM m GROUP BY key),
w AS (SELECT *, ([3, 1, 2])[nth % 3 + 1]::DOUBLE AS sw, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (
  SELECT *, cap / sw AS per_weight,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / sw, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(sw) OVER (ORDER BY cap / sw, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
o AS (SELECT arg_min(level, (per_weight, nth)) AS open_level FROM f WHERE level < per_weight),
t AS (SELECT key, source_size, coalesce(least(cap, open_level * sw), cap) AS target FROM f LEFT JOIN o ON true),
c AS (SELECT key, weight, sum(size)::BIGINT AS words FROM m GROUP BY ALL),
r1 AS (
  SELECT c.key, c.weight, t.source_size, t.target,
    t.target - coalesce(sum(words) OVER (PARTITION BY c.key ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE AS a,
    sum(weight * words) OVER (PARTITION BY c.key ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM c JOIN t USING (key)),
r2 AS (SELECT *, CASE WHEN free > 0 THEN a / free ELSE 0.0 END AS rate FROM r1),
r AS (
  SELECT key, max(source_size) AS source_size, max(target) AS target,
    coalesce(arg_max(rate, weight) FILTER (rate * weight <= 2.0), max(2.0::DOUBLE / weight)) AS rate
  FROM r2 GROUP BY key),
e AS (SELECT m.*, r.source_size, r.target, least(2.0::DOUBLE, rate * weight) AS e FROM m JOIN r USING (key)),
q AS (SELECT *, floor(e) AS certain, CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) * ((1 - (e - floor(e))) / (e - floor(e))) END AS q FROM e),
l AS (SELECT *, target - sum(certain * size) OVER (PARTITION BY key) AS lack FROM q),
p AS (SELECT *, sum(size) OVER (PARTITION BY key ORDER BY q, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM l WHERE q IS NOT NULL)
SELECT doc_id, size, source_size, target, ((certain + CASE WHEN before + size / 2.0 <= lack THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
UNION ALL
SELECT doc_id, size, source_size, target, (certain * size)::BIGINT FROM l WHERE q IS NULL
"""

ORACLES["op9_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
x AS (SELECT r, i, (coalesce(doc_id, 9223372036854775807), i) > min((coalesce(doc_id, 9223372036854775807), i)) OVER (PARTITION BY win) AS again FROM p),
g AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS k FROM x WHERE again),
k AS (SELECT d.r, d.doc_id, t.k, w[t.k] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(k)),
s AS (SELECT k.r, count(*) FILTER (g.k IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY k.k) FILTER (g.k IS NULL) AS kept FROM k LEFT JOIN g ON k.r = g.r AND k.k = g.k GROUP BY k.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""

ORACLES["op5_stupid_backoff"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT r, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before, CASE WHEN i > 2 THEN w[i - 2] END AS first, len(w) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT word, count(*) AS c FROM p GROUP BY 1),
b AS (SELECT before, word, count(*) AS c FROM p WHERE i > 1 GROUP BY 1, 2),
g AS (SELECT first, before, word, count(*) AS c FROM p WHERE i > 2 GROUP BY 1, 2, 3),
t AS (SELECT count(*) AS total FROM p),
x AS (
  SELECT p.*, greatest(1, total - n)::DOUBLE AS others,
    u.c - count(*) OVER (PARTITION BY r, p.word) AS cw,
    b.c - count(*) OVER (PARTITION BY r, p.before, p.word) AS cb,
    g.c - count(*) OVER (PARTITION BY r, p.first, p.before, p.word) AS cg
  FROM p CROSS JOIN t JOIN u USING (word) LEFT JOIN b ON b.before = p.before AND b.word = p.word
    LEFT JOIN g ON g.first = p.first AND g.before = p.before AND g.word = p.word),
y AS (SELECT *, lag(cw) OVER (PARTITION BY r ORDER BY i) AS ch, lag(cb) OVER (PARTITION BY r ORDER BY i) AS cp FROM x),
z AS (
  SELECT *, log2(greatest(cw, 0.5)::DOUBLE) - log2(others) AS one,
    CASE WHEN i = 1 THEN NULL WHEN cb > 0 THEN log2(cb::DOUBLE) - log2(greatest(ch, 1)::DOUBLE) ELSE log2(0.4::DOUBLE) + log2(greatest(cw, 0.5)::DOUBLE) - log2(others) END AS two
  FROM y),
v AS (SELECT r, i, cg, CASE WHEN i = 1 THEN one WHEN i = 2 THEN two WHEN cg > 0 THEN log2(cg::DOUBLE) - log2(greatest(cp, 1)::DOUBLE) ELSE log2(0.4::DOUBLE) + two END AS v FROM z),
s AS (SELECT r, count(*) FILTER (i > 2 AND cg > 0) AS seen, avg(v) AS score FROM v GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(seen, 0)::BIGINT AS n_seen, round(score, 4) AS log2_score FROM d LEFT JOIN s USING (r)
"""
