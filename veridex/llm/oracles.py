"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from veridex.llm.common import LOWER, UPPER
from veridex.llm.licenses import TEMPLATES
from veridex.llm.quality import COMMON_WORDS

ORACLES: dict[str, str] = {}

ORACLES["op3_url_filter"] = f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), m AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""

#: The water level is searched by rounds here: sources above their cap are held, the rest share anew.
ORACLES["op1_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, cast(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(cast(doc_id AS VARCHAR), 'null')) AS digest
  FROM documents
), s AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), rounds AS (
  SELECT 0 AS i, source, source_size, weight, false AS held FROM s
  UNION ALL
  SELECT i + 1, source, source_size, weight,
         held OR weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (held) OVER (), 0)) / nullif(sum(weight) FILTER (NOT held) OVER (), 0) > 3 * source_size
  FROM rounds WHERE i < 30
), t AS (
  SELECT source, source_size,
         CASE WHEN held THEN 3.0::DOUBLE * source_size
              ELSE weight * (((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (held) OVER (), 0))) / sum(weight) FILTER (NOT held) OVER ()) END AS target
  FROM rounds WHERE i = 30
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE cast(floor(target / source_size) AS BIGINT) END AS whole FROM t
), k AS (
  SELECT source, digest, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(size) / 2 AS middle
  FROM d GROUP BY source, digest
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       cast(d.size * (p.whole + CASE WHEN p.target - p.whole * p.source_size > 0 AND k.middle <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.digest = k.digest
"""

_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')""" % (UPPER, LOWER)

ORACLES["op5_decontaminate"] = f"""
WITH b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
b1 AS (SELECT item_id, w, unnest(CASE WHEN len(w) > 10 THEN range(1, len(w) - 8) ELSE [1] END) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM b1),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
d1 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, i, win.n, item_id FROM d1 JOIN win ON d1.n = win.n AND array_to_string(w[i:i + d1.n - 1], ' ') = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_VALUES = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in TEMPLATES.items())

#: Every window is compared with every template that shares a shingle with it.
ORACLES["op2_license_scan"] = f"""
WITH t0 AS (SELECT license, {_ITEM_WORDS} AS w FROM (VALUES {_VALUES}) v(license, text)),
t1 AS (SELECT license, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS places, list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS sh FROM t0),
t AS (SELECT license, k, sh, len(sh) AS m, greatest(1, places // 4) AS step, places + greatest(1, places // 4) - 1 AS width FROM t1),
ts AS (SELECT license, m, step, width, k, unnest(sh) AS s FROM t),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), ks AS (SELECT DISTINCT k FROM t),
ds AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, license, m, step, width, pos, ds.s FROM ds JOIN ts ON ds.s = ts.s AND ds.k = ts.k),
win AS (SELECT doc_id, license, m, (pos // step - k) * step AS start, width, s, pos FROM (SELECT *, unnest(range(0, (width - 1) // step + 1)) AS k FROM hit)),
held AS (SELECT doc_id, license FROM win WHERE start >= 0 AND start + width > pos GROUP BY doc_id, license, m, start HAVING 100 * count(DISTINCT s) >= 80 * m),
g AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS l FROM (SELECT DISTINCT doc_id, license FROM held) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_licenses, coalesce(l, '') AS licenses FROM documents LEFT JOIN g USING (doc_id)
"""

_BLANK = r"[\x20\x09-\x0D]"
#: The seven classes are named by what they count; the distances compare a document with its language.
ORACLES["op9_quality_rules"] = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, lang, t, w, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   cast(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
   list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1) r USING (doc_id, s)),
rc AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM rep GROUP BY doc_id),
lex AS (SELECT * FROM (VALUES {", ".join("('%s', %d, '%s')" % (k, i, x) for k, v in COMMON_WORDS.items() for i, x in enumerate(v))}) v(lang, bin, word)),
cw AS (SELECT doc_id, d.lang, bin, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS x FROM d) d JOIN lex ON d.lang = lex.lang AND (d.x = lex.word OR d.x = upper(lex.word[1:1]) || lex.word[2:]) GROUP BY ALL),
bins AS (SELECT doc_id, lang, 'w' AS h, bin, n FROM cw
  UNION ALL SELECT f.doc_id, f.lang, 'w', 99, n_words - coalesce(sum(n), 0) FROM f LEFT JOIN cw USING (doc_id) GROUP BY f.doc_id, f.lang, n_words
  UNION ALL SELECT doc_id, lang, 'c', unnest([0, 1, 2, 3, 4, 5, 6]), unnest([up, dig, n_symbols, pun, length(t) - word_chars, strlen(t) - length(t), word_chars - up - dig - n_symbols - pun])
    FROM (SELECT *, len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[0-9]')) AS dig, len(regexp_extract_all(t, '[.,;:!?()"\\x27-]')) AS pun FROM f)),
many AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20),
ref AS (SELECT lang, h, bin, sum(n) AS rn, sum(sum(n)) OVER (PARTITION BY lang, h) AS rt FROM bins JOIN many USING (lang) GROUP BY lang, h, bin),
pq AS (SELECT x.doc_id, x.h, coalesce(b.n, 0) / nullif(sum(coalesce(b.n, 0)) OVER (PARTITION BY x.doc_id, x.h), 0)::DOUBLE AS p, rn / rt::DOUBLE AS q
  FROM (SELECT doc_id, ref.* FROM f JOIN ref USING (lang) WHERE n_words >= 50) x LEFT JOIN bins b ON b.doc_id = x.doc_id AND b.h = x.h AND b.bin = x.bin),
js AS (SELECT doc_id, h, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END))) AS dist FROM pq GROUP BY doc_id, h),
sref AS (SELECT lang, sum(n_symbols) / nullif(sum(word_chars), 0)::DOUBLE AS q FROM f JOIN many USING (lang) GROUP BY lang),
sym AS (SELECT doc_id, p, q, (p + q) / 2 AS m FROM (SELECT doc_id, lang, n_symbols / word_chars::DOUBLE AS p FROM f WHERE word_chars >= 60) JOIN sref USING (lang)),
far AS (SELECT doc_id FROM sym WHERE p > q AND sqrt(greatest(0, 0.5 * (p * log2(p / m) + CASE WHEN p < 1 THEN (1 - p) * log2((1 - p) / (1 - m)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END + (1 - q) * log2((1 - q) / (1 - m))))) > 0.1
  UNION SELECT DISTINCT js.doc_id FROM js JOIN f USING (doc_id) WHERE (h = 'c' AND dist > 0.3) OR (h = 'w' AND dist > 0.31 AND lang IN (SELECT lang FROM lex)))
SELECT f.doc_id, n_words, word_chars, n_symbols, cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words) AND far.doc_id IS NULL AS kept
FROM f LEFT JOIN rc USING (doc_id) LEFT JOIN far ON f.doc_id = far.doc_id
"""

#: Every order is walked filter by filter over the counts of each set of failed filters.
ORACLES["op12_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), f AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
           WHEN 'A' THEN len(ws) < 50
           WHEN 'B' THEN 100 * len(list_distinct(ws)) < 65 * len(ws)
           WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)
           WHEN 'D' THEN regexp_matches(t, '[#$%&*|]')
           ELSE coalesce(doc_id > least, false) END) AS fails,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM w
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, cast(step AS INTEGER) AS step, filter_order[step:step] AS own, string_split(filter_order[1:step - 1], '') AS earlier
  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5
), x AS (
  SELECT c.*, s.*, list_contains(fails, own) AS fails_own, list_has_any(fails, earlier) AS fails_earlier FROM c, s
), r AS (
  SELECT part, filter_order, step, own,
         cast(coalesce(sum(n) FILTER (NOT fails_own AND NOT fails_earlier), 0) AS BIGINT) AS kept,
         cast(coalesce(sum(n) FILTER (fails_own AND NOT fails_earlier), 0) AS BIGINT) AS removed,
         cast(coalesce(sum(n) FILTER (fails_own AND fails_earlier), 0) AS BIGINT) AS redundant,
         cast(coalesce(sum(n) FILTER (fails = [own]), 0) AS BIGINT) AS unique_fails,
         cast(coalesce(sum(good) FILTER (fails_own AND NOT fails_earlier), 0) AS BIGINT) AS good_lost,
         cast(coalesce(sum(toxic) FILTER (fails_own AND NOT fails_earlier), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

ORACLES["op13_hard_negatives"] = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS alike, cast(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e a, e WHERE a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id AND len(a.v) = len(e.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, cast(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
