"""SQL for queries whose operators have none beside them: whole tables, plain definitions. Slow, for small tables."""

from __future__ import annotations

from .decontamination import _GRAMS

NEAR_DEDUP = f"""
WITH RECURSIVE g AS MATERIALIZED {_GRAMS.format(id="doc_id", table="documents")},
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS z FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z),
m AS (SELECT doc_id, min(z) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, d.doc_id = coalesce(m.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

SUFFIX_DEDUP = """
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM t)),
f AS MATERIALIZED (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS MATERIALIZED (SELECT w.doc_id, w.i, lag(w.i) OVER o AS before FROM w JOIN f USING (s) WHERE f.first < w.doc_id WINDOW o AS (PARTITION BY w.doc_id ORDER BY w.i)),
k AS (SELECT doc_id, i, before, sum((before IS NULL OR i - before > 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
s AS MATERIALIZED (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY ALL),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM s),
parts AS (SELECT q.doc_id, q.from_, substr(h, 2 * q.from_ + 1, 2 * (q.a - q.from_)) AS kept FROM q JOIN t USING (doc_id) UNION ALL SELECT t.doc_id, l.z, substr(h, 2 * l.z + 1) FROM (SELECT doc_id, max(z) AS z FROM s GROUP BY doc_id) l JOIN t USING (doc_id)),
j AS (SELECT doc_id, string_agg(kept, '' ORDER BY from_) AS kept FROM parts GROUP BY doc_id),
b AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(b.n_removed, 0)::BIGINT AS n_removed, coalesce(b.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(j.kept, h))) AS kept_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN j USING (doc_id)"""

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
MIXING_TARGETS = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
v AS (SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cut, coalesce(sum(weight) OVER o, 0) AS cut_weight, 1.5 * sum(source_size) OVER () AS goal, sum(weight) OVER () AS weights FROM v WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((goal - cut) / (weights - cut_weight), cut_weight) AS level FROM c WHERE (goal - cut) / (weights - cut_weight) * weight <= cap)
SELECT d.doc_id, d.size, c.source_size::BIGINT AS source_size, round(least(cap, coalesce(level * weight, cap)), 6)::DOUBLE AS target FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source, l"""

CLASS_LM_BASE = f"""
WITH RECURSIVE crc AS (SELECT x, x AS v, 0 AS i FROM range(256) t(x) UNION ALL SELECT x, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM crc WHERE i < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY x) AS t FROM crc WHERE i = 8),
d AS MATERIALIZED (SELECT doc_id, list_append({_WORDS}, chr(10)) AS w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 5 = 1 AS held_out FROM documents, tab),
k AS MATERIALIZED (SELECT doc_id, held_out, unnest(w) AS word FROM d),
c AS MATERIALIZED (SELECT word, count(*) AS c FROM k WHERE NOT held_out GROUP BY word), n AS (SELECT sum(c)::DOUBLE AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(n.n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 6) AS base_score FROM k LEFT JOIN c USING (word), n GROUP BY doc_id, held_out"""
