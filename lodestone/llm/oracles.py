r"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

OP2 = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM s GROUP BY source),
lv AS (
  SELECT *, ((SELECT sum(source_size) FROM per)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * (SELECT max(CASE WHEN level <= cap / weight THEN level END) FROM lv)) AS target
  FROM lv),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (
  SELECT s.*, k.source_size, k.target, k.copies, k.target - k.copies * k.source_size AS need,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM s JOIN k ON s.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0
            ELSE size * (copies + CASE WHEN upto <= need OR (upto - own <= need AND upto - need < need - (upto - own)) THEN 1 ELSE 0 END)
       END::BIGINT AS taken
FROM g
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
b AS (SELECT *, length(x) // 2 AS n FROM d),
c AS (
  SELECT r, doc_id, n, f, substr(x, 2 * f + 1, 1122) AS part
  FROM (SELECT r, doc_id, x, n, unnest(generate_series(0, n - 50, 512)) AS f FROM b WHERE n >= 50 AND doc_id IS NOT NULL)),
g AS (
  SELECT r, doc_id, f + i AS i, md5_number(substr(part, 2 * i + 1, 100)) AS k
  FROM (SELECT r, doc_id, f, part, unnest(generate_series(0, least(511, n - 50 - f))) AS i FROM c)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
s AS (SELECT r, i FROM g JOIN m USING (k) WHERE doc_id > least),
o AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS j FROM s),
w AS (SELECT r, i, sum(CASE WHEN j IS NULL OR i > j + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM o),
v AS (SELECT r, span, min(i) AS a, max(i) + 50 AS z FROM w GROUP BY r, span),
kept AS (
  SELECT r, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS y,
         sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans
  FROM (SELECT v.*, x, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM v JOIN b USING (r)) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM b LEFT JOIN kept USING (r)
"""

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
pos AS (
  SELECT r, doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, n, i, item_id FROM pos JOIN bw USING (n, win)),
hw AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS j FROM hits) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

OP9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
f AS (
  SELECT *,
         '<turn>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*/?turn>)', '<\\\1', 'g') || chr(10)
         || regexp_replace(text, '<(\\*/?turn>)', '<\\\1', 'g') || '</turn>' || chr(10) AS rendered
  FROM rows)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(rendered))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

#: crc32 of a list of bytes `{0}`, with the table `crc` (one row, list t of 256) in scope.
CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, {0}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT"
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, x: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256))::UBIGINT AS i)))"


def _crc(text: str) -> str:
    """SQL for the crc32 of a text's UTF-8 bytes."""
    return CRC.format(f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::UBIGINT)")


OP11 = f"""
WITH {CRC_TABLE},
e AS (
  SELECT 2 * (conv_id >> 3) + c % 2 AS "user", (c // 2) % 7200 + 300 * turn + h % 600 AS s, h // 600 AS g, h
  FROM (SELECT conv_id, turn, {_crc("conv_id::VARCHAR")} AS c, {_crc("conv_id::VARCHAR || ':' || turn::VARCHAR")} AS h
        FROM conversations, crc WHERE turn IS NOT NULL AND conv_id IS NOT NULL)),
v AS (SELECT "user", s, h, floor(s / 1800)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch FROM e),
x AS (SELECT v."user", b.batch, s, h, v.batch AS own FROM (SELECT DISTINCT "user", batch FROM v) b JOIN v ON v."user" = b."user" AND v.batch <= b.batch),
o AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY "user", batch ORDER BY s) <= 240 THEN 0 ELSE 1 END AS opens FROM x),
k AS (SELECT *, sum(opens) OVER (PARTITION BY "user", batch ORDER BY s) AS nr FROM o),
w AS (
  SELECT "user", batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (WHERE own = batch) AS n_new, sum(h)::BIGINT AS h_sum
  FROM k GROUP BY "user", batch, nr HAVING n_new > 0),
r AS (
  SELECT a."user", a.batch, a.start_s, min(b.batch) AS retracted_batch, arg_min(b.start_s, b.batch) AS retracted_start_s
  FROM w a JOIN w b ON a."user" = b."user" AND b.batch > a.batch AND b.start_s <= a.start_s AND a.end_s <= b.end_s GROUP BY ALL),
n AS (SELECT "user", retracted_batch AS batch, retracted_start_s AS start_s, count(*) AS n FROM r GROUP BY ALL)
SELECT w.*, coalesce(n, 0)::BIGINT AS n_retracted, retracted_batch, retracted_start_s
FROM w LEFT JOIN r USING ("user", batch, start_s) LEFT JOIN n USING ("user", batch, start_s)
"""

OP12 = rf"""
WITH {CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM b),
k AS (SELECT f, {_crc("f")} % 10000 AS k FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT k, count(*) AS s FROM df JOIN k USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN k USING (f) GROUP BY k),
g AS (
  SELECT s.k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM s)::DOUBLE / ((s + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + 10000 FROM t)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (k)),
m AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM df JOIN k USING (f) JOIN g USING (k) GROUP BY r),
z AS (
  SELECT r, doc_id, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN m USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) AS rank FROM z WHERE n_features >= 39)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT floor(25 * count(*) / 100) FROM o) THEN rank END AS rank FROM z LEFT JOIN o USING (r)
"""

ORACLES = {"op2_mix_sources": OP2, "op5_suffix_dedup": OP5, "op6_decontaminate": OP6, "op9_chat_format": OP9, "op11_late_sessions": OP11, "op12_resample": OP12}
