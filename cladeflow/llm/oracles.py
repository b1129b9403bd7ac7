"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from . import mixing, quality_rules

WORD = r"[^\x20\x09-\x0D]+"

OP2 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(concat('{mixing.SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))), 1, 13)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight, source_size * 3 AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM w),
r AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
             CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_weight FROM o),
f AS (SELECT min(place) AS first_open FROM r WHERE cap * rest_weight >= rest * weight),
t AS (SELECT r.source, r.source_size, CASE WHEN r.place < first_open THEN CAST(r.cap AS DOUBLE) ELSE CAST(p.rest * r.weight AS DOUBLE) / CAST(p.rest_weight AS DOUBLE) END AS target
      FROM r, f, r AS p WHERE p.place = f.first_open),
q AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
x AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0::DOUBLE <= q.target - q.whole * q.source_size AS extra
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN extra AND size > 0 THEN 1 ELSE 0 END) AS taken,
       CASE WHEN size > 0 THEN whole + CASE WHEN extra THEN 1 ELSE 0 END ELSE 0 END AS repetitions FROM x
"""

_BITS = " + ".join(f"CASE WHEN {c} THEN {quality_rules.bit(r)} ELSE 0 END" for r, c in quality_rules.RULES.items())
_BASE = sum(map(quality_rules.bit, quality_rules.BASE))

OP8 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{WORD}') AS w FROM t),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, concat(word, ' ', lead(word, 1) OVER p, ' ', lead(word, 2) OVER p) AS g, lead(word, 2) OVER p IS NOT NULL AS whole FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE whole),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, range(3) k(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM t),
m AS (
  SELECT t.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(text) - length(regexp_replace(text, '{WORD}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l.l) AS n_lines,
         length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[\\p{{Lu}}\\p{{Ll}}]', '', 'g')) AS n_letters
  FROM t JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {_BASE}) <> 0 AS base_failed, (fail_bits & {quality_rules.mask(quality_rules.PRODUCTION)}) = 0 AS kept, fail_bits FROM b
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TOKEN}') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{_TOKEN}') AS w FROM benchmark),
n AS (SELECT item, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
e AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM n) WHERE len(w) >= n)),
h AS (SELECT e.r, e.k, e.n, g.item FROM e JOIN g USING (n, gram)),
p AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT r, k, unnest(range(n)) AS j FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
                CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN min(d.doc_id) OVER (PARTITION BY text) < d.doc_id THEN 'E' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS step),
r AS (SELECT f.*, filter_order, coalesce(list_min([i for i in range(1, 6) if contains(fails, substr(filter_order, i, 1))]), 6) AS gone FROM f, o),
c AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, count(*) FILTER (WHERE gone > step) AS kept, count(*) FILTER (WHERE gone = step) AS removed,
         count(*) FILTER (WHERE gone < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, count(*) FILTER (WHERE fails = substr(filter_order, step, 1)) AS unique_fails,
         count(*) FILTER (WHERE gone = step AND good = 1) AS good_lost, count(*) FILTER (WHERE gone = step AND toxic = 1) AS toxic_lost
  FROM r, s GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM c
"""

#: The unsigned CRC-32 of a decimal number: its bytes' bits are folded one by one.
_CRC = """xor(list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(CAST({c} AS VARCHAR), '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

OP11 = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS k FROM t),
c AS (SELECT c, c - c % 100 AS base, {_CRC.format(c="c")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, k, role, text FROM c JOIN n ON n.c = c.base AND k <= h UNION ALL SELECT c.c, k, role, text FROM c JOIN n ON n.c = c.c AND k > h),
d AS (SELECT c, row_number() OVER p AS depth, list(concat(length(role), ':', role, length(text), ':', text)) OVER p AS path, length(text) AS size FROM r WINDOW p AS (PARTITION BY c ORDER BY k)),
m AS (SELECT * FROM d UNION ALL SELECT c, 0, CAST([] AS VARCHAR[]), 0 FROM c),
e AS (SELECT c, max(depth) AS last FROM m GROUP BY c),
v AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = last) AS ends
      FROM m JOIN e USING (c) GROUP BY path, depth),
u AS (SELECT path, count(*) AS n_children FROM (SELECT path[: depth - 1] AS path FROM v WHERE depth > 0) GROUP BY path),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN u USING (path)),
s AS (SELECT path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT path[: unnest(range(0, depth + 1))] AS path, saved, n_children FROM w) GROUP BY path)
SELECT CAST(w.conv_id AS BIGINT) AS conv_id, CAST(w.depth AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN v p ON w.depth > 0 AND p.path = w.path[: w.depth - 1]
"""

SQL: dict[str, str] = {"op2_mix": OP2, "op7_decontamination": OP7, "op8_quality_rules": OP8, "op11_prefix_trie": OP11, "op12_filter_audit": OP12}
