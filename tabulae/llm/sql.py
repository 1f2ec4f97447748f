"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .line_dedup import MIN_CHARS, MIN_DOCS
from .recompress import WINDOW
from .sharding import OVERHEAD

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = rf"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, raw,
         translate(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k
  FROM line),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

SUBSTRING_DEDUP = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM doc WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
edge AS (
  SELECT doc_id, i AS p, 1 AS d FROM again UNION ALL SELECT doc_id, i + {WINDOW}, -1 FROM again
  UNION ALL SELECT doc_id, unnest(range(1, len(w) + 1)), 0 FROM doc),
cover AS (
  SELECT doc_id, p, sum(sum(d)) OVER (PARTITION BY doc_id ORDER BY p) AS c FROM edge GROUP BY doc_id, p),
word AS (
  SELECT doc.doc_id, p, c, w[p] AS x FROM doc JOIN cover ON doc.doc_id = cover.doc_id AND p <= len(w)),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE c > 0) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE c = 0) AS t
  FROM word GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)"""

# CRC-32 has no DuckDB function: a table of 256 entries, and a fold over the bytes.
SHARDING = rf"""
WITH RECURSIVE step AS (
  SELECT b, b::BIGINT AS v, 0 AS k FROM range(256) r(b)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 9) || substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT AS k,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                                   lambda x: ('0x' || x)::BIGINT)),
           lambda c, x: xor(crc.t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents, crc),
run AS (
  SELECT *, sum(size) OVER (ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS until, sum(size) OVER () AS total FROM sized),
dealt AS (
  SELECT *, floor((2 * until - size) / (2.0::DOUBLE * total) * 40)::INTEGER AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY k, doc_id, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt"""

FILTER_AUDIT = r"""
WITH raw AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
word AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM raw),
lab AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
fail AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(doc_id > least, false) THEN 'E' ELSE '' END AS fails
  FROM word LEFT JOIN lab USING (doc_id)),
tally AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fail GROUP BY part, fails),
letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
chain AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
place AS (SELECT o, unnest(range(1, 6))::INTEGER AS step FROM chain),
step AS (
  SELECT part, o AS filter_order, step, o[step] AS x,
         coalesce(sum(n) FILTER (WHERE translate(fails, o[1:step], '') = fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE contains(fails, o[step]) AND NOT hit), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = o[step]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE hit), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE hit), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, contains(fails, o[step]) AND translate(fails, o[1:step - 1], '') = fails AS hit FROM tally, place)
  GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM step"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
pair AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, x.r AS x, x.vec_id AS id, a.label = x.label AS same,
         list_inner_product(a.q, x.q)::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.r <> x.r),
pos AS (
  SELECT a, anchor_id, x, id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= 5),
neg AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY a, pos.x ORDER BY score DESC, id NULLS LAST) AS rank
  FROM pos JOIN (SELECT a, id, score FROM pair WHERE NOT same) USING (a)
  WHERE 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""
