"""DuckDB SQL with the same rows as the training-data queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
w AS (SELECT *, CAST([5.0, 2.0, 1.0][place % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3.0 AS cap FROM r),
o AS (SELECT *, cap / weight AS full_at,
  sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open_weight FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT rest / open_weight FROM o WHERE rest / open_weight <= full_at ORDER BY full_at, place LIMIT 1)) AS target FROM o),
n AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) - 1 AS pos,
  CAST(('0x' || substr(md5('mix-1:' || coalesce(d.source, chr(0))), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * (floor((pos + 1) * rate + u) - floor(pos * rate + u)) AS BIGINT) AS taken FROM n
"""

SHARDS = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
  CAST(('0x' || substr(md5(coalesce(text, '')), 1, 15)) AS BIGINT) AS k FROM documents),
c AS (SELECT doc_id, size, k, xor(list_reduce(list_prepend(4294967295, CAST(list_transform(range(size - 1), lambda i: CAST(('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)) AS BIGINT[])),
  lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS text_crc32 FROM d, crc),
p AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
h AS (SELECT doc_id, size, text_crc32, k, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM h
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 26 + length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(s>|/s>|ROLE\]|INST\]|/INST\])', '\1~\2', 'g'))
  + length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(s>|/s>|ROLE\]|INST\]|/INST\])', '\1~\2', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

LEAKS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
w AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(list_slice(words, i, i + least(10, len(words)) - 1), ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
g AS (SELECT r, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS gram
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
m AS (SELECT g.r, g.i, g.n, w.item FROM g JOIN w ON g.n = w.n AND g.gram = w.gram),
hits AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
