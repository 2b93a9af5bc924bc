"""DuckDB SQL of the training-data queries that SQL can express.

Constants are written out, not imported from the operators. Operators 1, 3, 4,
5, 10 and 11 have none (trained models, dictionaries, random walks); their tests
use brute-force versions.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS share,
         row_number() OVER (ORDER BY source_size::DOUBLE / w, source IS NULL, source) AS pos
  FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / w, source IS NULL, source
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(share, pos) AS level FROM f WHERE share * w < 3 * source_size),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(level * w, 3.0::DOUBLE * source_size)) AS target
      FROM f CROSS JOIN lv),
seats AS (SELECT floor(sum(target) / 32 + 0.5)::BIGINT AS n, count(*) AS k, sum(target) AS total FROM t),
q AS (
  SELECT source, target / (2 * i + 1) AS quotient, i
  FROM t, seats, LATERAL (SELECT unnest(generate_series(0, ceil(target * (n + k) / total)::BIGINT + 1)) AS i) g
  WHERE total > 0 AND target > 0),
won AS (
  SELECT source, count(*) AS blocks
  FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source IS NULL, source, i) AS r FROM q), seats
  WHERE r <= n GROUP BY source),
sq AS (
  SELECT t.source, source_size, target, coalesce(blocks, 0) AS blocks, source_size // 200000 + 1 AS shards
  FROM t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source),
p AS (
  SELECT d.*, sq.source_size, sq.target, sq.blocks, d.h % sq.shards AS shard
  FROM d JOIN sq ON d.source IS NOT DISTINCT FROM sq.source),
sh AS (
  SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(blocks) AS blocks,
         any_value(source_size) AS source_size
  FROM p GROUP BY source, shard),
shq AS (
  SELECT source, shard, shard_size::DOUBLE / (2 * i + 1) AS quotient, i, blocks
  FROM sh, LATERAL (SELECT unnest(generate_series(0, blocks)) AS i) g WHERE shard_size > 0),
shwon AS (
  SELECT source, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard, i) AS r FROM shq)
  WHERE r <= blocks GROUP BY source, shard),
shs AS (
  SELECT sh.source, sh.shard, shard_size, greatest(floor(shard_size / 32.0 + 0.5), 1)::BIGINT AS n,
         coalesce(quota, 0)::BIGINT AS quota0,
         ('0x' || substr(md5('mix|' || coalesce(sh.source, '') || '|' || sh.shard::VARCHAR), 1, 12))::BIGINT AS seed
  FROM sh LEFT JOIN shwon ON sh.source IS NOT DISTINCT FROM shwon.source AND sh.shard = shwon.shard),
run AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, x.shard_size, x.n, least(quota0, 3 * n) AS quota, seed % n AS first,
         sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY h, p.doc_id, p.size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM p JOIN shs x ON p.source IS NOT DISTINCT FROM x.source AND p.shard = x.shard),
z AS (
  SELECT *, stop - size AS start, first + quota % n AS last FROM run)
SELECT doc_id, size, source_size, target,
       ((quota // n) * size
        + greatest(least(stop, (least(last, n) * shard_size) // n) - greatest(start, (first * shard_size) // n), 0)
        + greatest(least(stop, (greatest(last - n, 0) * shard_size) // n) - start, 0))::BIGINT AS taken
FROM z
"""

OP6 = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
k AS (SELECT *, nullif(regexp_extract(path, '^/[^/]*/([0-9]{1,18})(?:[^0-9]|$)', 1), '')::BIGINT AS key FROM p),
o AS (
  SELECT doc_id AS key, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, list_extract(string_split(host, '.'), -1) AS suffix,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain
  FROM k LEFT JOIN o USING (key) GROUP BY host),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
sf AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM dm GROUP BY suffix),
levels AS (
  SELECT 'h' AS level, n::DOUBLE AS n, k::DOUBLE AS k FROM h UNION ALL
  SELECT 'd', n, k FROM dm UNION ALL SELECT 's', n, k FROM sf),
m AS (
  SELECT level, sum(n) AS sn, sum(k) AS sk, count(*) FILTER (n > 0) AS g, sum(k * k / n) FILTER (n > 0) AS skk,
         sum(n * n) FILTER (n > 0) AS snn FROM levels GROUP BY level),
v AS (
  SELECT level, (skk - sk * sk / nullif(sn, 0)) / nullif(g - 1, 0) AS msb, (sk - skk) / nullif(sn - g, 0) AS msw,
         (sn - snn / nullif(sn, 0)) / nullif(g - 1, 0) AS n0 FROM m),
r AS (SELECT level, (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) AS rho FROM v),
st AS (SELECT level, CASE WHEN rho > 0 THEN greatest(least(1 / rho - 1, 1000.0), 2.0) ELSE 1000.0 END AS a FROM r),
al AS (SELECT (sum(k) + 1) / (sum(n) + 10) AS post FROM sf),
sp AS (SELECT suffix, (k + a * post) / (n + a) AS post FROM sf, al, st WHERE level = 's'),
dp AS (SELECT domain, (k + a * post) / (n + a) AS post FROM dm JOIN sp USING (suffix), st WHERE level = 'd'),
hp AS (SELECT host, (k + a * post) / (n + a) AS post, n + a AS total FROM h JOIN dp USING (domain), st WHERE level = 'h'),
b AS (SELECT host, post - 1.645 * sqrt(post * (1 - post) / (total + 1)) AS lower FROM hp),
j AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN lower > 0.35 THEN 'block' ELSE 'allow' END AS verdict
FROM j JOIN b USING (host)
"""

OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8),
g AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM w),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS k FROM g) WHERE k > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 8) t(k) GROUP BY rid),
top AS (SELECT rid, max(k) AS k FROM (SELECT rid, word, count(*) AS k FROM (SELECT rid, unnest(words) AS word FROM d) GROUP BY rid, word) GROUP BY rid),
m AS (
  SELECT d.*, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_stressed, coalesce(top.k, 0) AS top_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper
  FROM d LEFT JOIN r USING (rid) LEFT JOIN top USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= 2 * n_words
       AND 10 * n_dup_lines <= 3 * n_lines AND 10 * n_stressed <= 3 * n_words AND 10 * top_words <= 4 * n_words
       AND 10 * n_upper <= 5 * n_words AS kept
FROM b
"""

OP8 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
e AS MATERIALIZED (
  SELECT x, y FROM c JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id)::BIGINT AS component_id
FROM d JOIN reach ON reach.x = d.rid JOIN d o ON o.rid = reach.y LEFT JOIN n ON n.rid = d.rid
GROUP BY d.rid, d.doc_id
"""

_UUID = "'urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
_CRLF = "chr(13) || chr(10)"

OP9 = rf"""
WITH a AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS pd FROM pages),
b AS (
  SELECT *, sha256('response|' || coalesce(page_id::VARCHAR, 'null') || '|' || uri || '|' || pd) AS rh,
    'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(payload)::VARCHAR AS headers,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload,
      '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>', ' ', 'g'),
      '[\x00-\x20]+', ' ', 'g'),
      '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|title|header|blockquote|pre)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS t0
  FROM a),
c AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(t0, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
      '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t1 FROM b),
e AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(t1, ' *\n[ \n]*', chr(10), 'g'), ' +', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS txt,
    {_UUID.format('rh')} AS rid FROM c),
f AS (
  SELECT *, 'fetch-status: 200' || {_CRLF} || 'source-content-type: text/html; charset=utf-8' || {_CRLF} || 'source-payload-digest: sha256:' || pd
    || {_CRLF} || 'source-payload-length: ' || strlen(payload)::VARCHAR || {_CRLF} || 'text-digest: sha256:' || sha256(txt) || {_CRLF} AS meta FROM e),
g AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, meta AS block FROM f UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', txt FROM f),
h AS (SELECT *, sha256(block) AS bd, sha256(record_type || '|' || rid || '|' || sha256(block)) AS nh FROM g)
SELECT page_id, record_type, {_UUID.format('nh')} AS record_id, rid AS refers_to, uri AS target_uri, '1970-01-01T00:00:00Z' AS warc_date,
  content_type, headers AS source_headers, 'sha256:' || pd AS payload_digest, 'sha256:' || bd AS block_digest,
  strlen(block)::BIGINT AS content_length, block
FROM h
"""

OP12 = r"""
WITH RECURSIVE tb AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) AS tab
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
held AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs GROUP BY doc_id, run),
crc AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM held, tb),
w AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS (
  SELECT word, n, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r
  FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w)),
near AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN w ON w.word = g.l || g.r
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN w ON w.word = g.l || g.r),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
         CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word),
walk AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN ends ON ends.word = f.word
"""

_DOUBLED = ", ".join(
    f"""
t{2 * n} AS (
  SELECT a.doc_id, a.s, dense_rank() OVER (ORDER BY a.r, b.r) AS r FROM t{n} a JOIN t{n} b ON a.doc_id = b.doc_id AND b.s = a.s + {n})"""
    for n in (5 * 2**k for k in range(12))
)
_HELD = " UNION ALL ".join(f"SELECT doc_id, {5 * 2**k} AS size, count(*) OVER (PARTITION BY r) AS held FROM t{5 * 2**k}" for k in range(2, 13))

OP13 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
t5 AS (
  SELECT doc_id, s, dense_rank() OVER (ORDER BY array_to_string(words[s:s + 4], ' ')) AS r
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS s FROM d WHERE len(words) >= 5)),{_DOUBLED},
far AS (SELECT doc_id, max(size)::BIGINT AS longest FROM ({_HELD}) WHERE held > 1 GROUP BY doc_id),
starts AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS s FROM d WHERE len(words) >= 20),
runs AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) AS r
  FROM starts),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM runs, generate_series(0, 19) g(j) WHERE r > 1),
w AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM d),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text
  FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(longest, 0) AS longest
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN far ON far.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {
    "op2_mixing": OP2,
    "op6_url_filter": OP6,
    "op7_quality_rules": OP7,
    "op8_ngram_jaccard": OP8,
    "op9_warc_derivatives": OP9,
    "op12_spelling_variants": OP12,
    "op13_substring_dedup": OP13,
}
