"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from tankline.llm import license_scan, url_filter

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_quote(x) for x in xs) + "]"


_SETS = license_scan.template_sets(license_scan.TEMPLATES)
OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
hits AS (
  SELECT rid, i, label FROM (SELECT rid, w, unnest(range(len(w))) AS i FROM d),
    (VALUES {', '.join(f"({_list(p.split())}, {_quote(l)})" for p, l in license_scan.PHRASES)}) AS ph(p, label)
  WHERE w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY rid),
blocks AS (SELECT rid, list_distinct(w[b * {license_scan.BLOCK // 2} + 1 : b * {license_scan.BLOCK // 2} + {license_scan.BLOCK}]) AS bw
  FROM (SELECT rid, w, unnest(range(1 + len(w) // {license_scan.BLOCK // 2})) AS b FROM d WHERE len(w) > 0)),
tpl AS (SELECT rid, label, max(len(list_intersect(t, bw)) / len(t)) AS c FROM blocks,
    (VALUES {', '.join(f"({_list(t)}, {_quote(l)})" for _, l, t in _SETS)}) AS tp(t, label)
  GROUP BY rid, label, t HAVING max(len(list_intersect(t, bw))) >= ceil({license_scan.THRESHOLD} * len(t) - 1e-9)),
tl AS (SELECT rid, list(DISTINCT label) AS labels, max(c) AS c FROM tpl GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(tl.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(tl.c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN tl USING (rid)
"""

_BASE = [r for r in url_filter.DEFAULT_RULES if r.exact]
_METHOD = [r for r in url_filter.DEFAULT_RULES if not r.exact]
OP5 = f"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
hp AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM hp,
  (VALUES {', '.join(f"({_quote(r.label)}, {_quote(r.label[: r.label.index('/')])}, {_quote(r.label[r.label.index('/'):])}, {_quote(r.action)})" for r in _BASE)})
    AS t(rule, rh, rp, action)
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
m AS (SELECT DISTINCT rid FROM hp WHERE {' OR '.join(f"regexp_matches(host || path, {_quote(r.pattern)})" for r in _METHOD)})
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN m.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM hp LEFT JOIN r USING (rid) LEFT JOIN m USING (rid)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, len({TOKENS}) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, 2 * source_size AS bound FROM s0),
s2 AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, [-0.5::DOUBLE, 0.0, 0.5][rank % 3 + 1] AS slope FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY bound::DOUBLE / weight, rank) AS rn FROM s2),
s4 AS (SELECT *, ((SELECT sum(source_size)::BIGINT FROM s0) * 1.5::DOUBLE
    - coalesce(sum(bound) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lv FROM s3),
lam AS (SELECT arg_min(lv, rn) AS level FROM s4 WHERE bound > lv * weight),
t AS (SELECT source, source_size, slope, least(bound::DOUBLE, coalesce((SELECT level FROM lam) * weight, bound::DOUBLE)) AS target FROM s4),
c AS (SELECT d.*, source_size, slope, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN size > 0 AND 2 * st + size < 2 * target THEN 1 ELSE 0 END AS one,
  CASE WHEN size > 0 AND 2 * (st + source_size) + size < 2 * target THEN 1 ELSE 0 END AS two FROM c),
p AS (SELECT *, least(greatest(CASE WHEN one = 1 THEN st ELSE st + source_size END / target, 0.0::DOUBLE), 1.0::DOUBLE) AS fr FROM f)
SELECT doc_id, size, source_size, target, (size * (one + two))::BIGINT AS taken,
  CASE WHEN one + two = 0 THEN NULL WHEN slope = 0 THEN fr
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * fr) - (1 - slope)) / (2 * slope) END AS position
FROM p
"""

OP10 = f"""
WITH it AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, w[i + 1 : i + 10] AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM it WHERE len(w) > 0)),
sz AS (SELECT DISTINCT len(win) AS n FROM win),
d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
cand AS (SELECT rid, n, i, w[i + 1 : i + n] AS win FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sz WHERE len(w) >= n)
  WHERE hash(w[i + 1 : i + n]) IN (SELECT hash(win) FROM win)),
hit AS (SELECT c.rid, c.i, c.n, win.item FROM cand c JOIN win ON c.win = win.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

_ESC = r"regexp_replace(t, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|ROLE |/ROLE\])', '\1\2\\\3', 'g')"
OP4 = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length({_ESC}) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 6 ELSE 16 + length(role) END))::BIGINT AS formatted_chars,
  0 AS n_rewrites
FROM c GROUP BY conv_id
"""

OP7 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN r USING (h)
"""

#: CRC-32 by its table, which is made from the reversed polynomial; one pass over the distinct words.
OP12 = r"""
WITH lut AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT 0 AS tgt, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL
    SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
n AS (SELECT tgt, id, word, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM n)),
b AS (SELECT word, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM h),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1])), 4294967295) % 10000 AS bucket FROM b, lut),
c AS (SELECT bucket, sum(CASE WHEN tgt = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN tgt = 1 THEN n ELSE 0 END) AS t FROM n JOIN k USING (word) GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM c, tot),
d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN k USING (word) JOIN g USING (bucket) WHERE tgt = 0 GROUP BY id),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
    FROM documents LEFT JOIN d ON doc_id = id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank
FROM e LEFT JOIN r ON e.doc_id = r.doc_id
"""
