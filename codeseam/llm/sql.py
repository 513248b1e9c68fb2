"""DuckDB SQL of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP9 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS u, {_words('text')} AS w FROM documents),
i AS (SELECT item_id, {_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
ip AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM ip),
sizes AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT u, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes),
hits AS (SELECT dp.u, dp.p, dp.n, iw.item_id FROM dp JOIN iw ON dp.n = iw.n AND array_to_string(list_slice(w, p, p + dp.n - 1), ' ') = iw.g),
pos AS (SELECT DISTINCT u, unnest(range(p, p + n)) AS q FROM hits),
h AS (SELECT u, count(*) AS hit FROM pos GROUP BY u),
t AS (SELECT u, count(*) AS items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT u, item_id FROM hits) GROUP BY u)
SELECT doc_id, len(w) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (u) LEFT JOIN t USING (u)
"""


def _controls(text: str) -> str:
    return f"len(regexp_extract_all({text}, '<⁠*/?s>|\\[⁠*/?(?:SYS|INST|ROLE|MSG)\\]'))"


OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM c),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
f AS (SELECT *, CASE WHEN i = 0 THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' ELSE false END AS fits,
  CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 24 + length(role) + {_controls('role')} END + length(text) + {_controls('text')} AS chars FROM p),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
  coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS learned, sum(chars)::BIGINT AS formatted_chars,
  (min(i) FILTER (NOT fits))::INTEGER AS bad_turn, arg_max(role, i) AS final FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
  bad_turn IS NULL AND final = 'assistant' AS valid, bad_turn FROM g
"""

OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda k: lpad(bin(strpos('0123456789abcdef', substr(h, k, 1)) - 1), 4, '0')), '') AS bits FROM o)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT + 2 * substr(bits, 5 * k + 4, 1)::INT
    + substr(bits, 5 * k + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

OP13 = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::HUGEINT AS w FROM d GROUP BY source),
-- by size over weight: those before the first that stays within its bound are held at it
r AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source) AS k FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS held,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS ws, (sum(source_size) OVER ())::HUGEINT AS t FROM r),
f AS (SELECT min(k) AS first, min_by(3 * t - 4 * held, k) AS top, min_by(ws, k) AS ws FROM c WHERE w * (3 * t - 4 * held) <= 4 * ws * source_size),
g AS (SELECT source, source_size, CASE WHEN k < first THEN (2 * source_size)::DOUBLE ELSE least((2 * source_size)::DOUBLE, w::DOUBLE * (top::DOUBLE / 2) / ws::DOUBLE) END AS target FROM r, f),
e AS (SELECT *, floor(CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size::DOUBLE) ELSE 0 END * 1e12::DOUBLE + 0.5)::HUGEINT AS expected,
  substr(md5('mix-1:' || coalesce('=' || source, 'null')), 1, 5) AS h FROM g),
o AS (SELECT *, list_reduce(list_transform(range(1, 6), lambda i: strpos('0123456789abcdef', substr(h, i, 1)) - 1), lambda a, b: a * 16 + b)::BIGINT AS bits FROM e),
u AS (SELECT *, floor(((2 * bits + 1) * 1953125000)::DOUBLE / 4096.0::DOUBLE)::HUGEINT AS off FROM o),
p AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.expected,
  sum(u.expected) OVER (PARTITION BY d.source ORDER BY d.size NULLS FIRST, d.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::HUGEINT + off AS upto FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * ((upto // 1000000000000) - ((upto - expected) // 1000000000000)))::BIGINT AS taken FROM p
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS u, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT u, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY lang, term HAVING count(DISTINCT u) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
  1 + (1000000000 * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::HUGEINT AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM f WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
