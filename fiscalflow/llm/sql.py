"""DuckDB SQL of the queries that SQL can express, written apart from the Spark code.

Tokenizers, XXH64 fingerprints, the learned lexicon and model, HTML markup and
approximate search have no SQL form; their queries are tested against brute force.
"""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), windows AS (
  SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS w
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM cut)
), twice AS (
  SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, w) > 1
), covered AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY k
), measured AS (
  SELECT doc_id, t, ws, ls,
         len(ws) AS n_words,
         length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letter_words,
         len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS echoes,
         length(regexp_replace(t, '[^!]', '', 'g')) AS exclamations
  FROM cut LEFT JOIN covered USING (k)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed
         AND 10 * n_symbols <= n_words
         AND 100 * n_dup_lines <= 40 * len(ls)
         AND word_chars BETWEEN 2 * n_words AND 15 * n_words
         AND 100 * capitals <= 40 * letters
         AND 2 * letter_words >= n_words
         AND 5 * echoes <= n_words
         AND 2 * exclamations <= n_words AS kept
FROM judged
"""

LEXICAL_SEARCH = r"""
WITH words AS (
  SELECT k, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (
    SELECT row_number() OVER () AS k, doc_id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
  )
), tf AS (
  SELECT k, any_value(doc_id) AS doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY k, term
), len AS (
  SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY k
), corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, docs
), asked AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times
  FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL
  ) GROUP BY item_id, term
), scored AS (
  SELECT item_id, k, any_value(doc_id) AS doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN len USING (k), corpus
  WHERE doc_id IS NOT NULL
  GROUP BY item_id, k
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

HARD_NEGATIVES = r"""
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM fine a JOIN fine c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), found AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives JOIN pairs USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op7_quality_rules": QUALITY_RULES,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_hard_negatives": HARD_NEGATIVES,
}
