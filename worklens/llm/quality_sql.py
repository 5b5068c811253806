"""Check SQL of the quality rules and of the repeated passages, by their definitions."""

from .quality import (
    GRAM_LIMITS, LINE_CHAR_LIMIT, LINE_LIMIT, MAX_REPEAT_PERCENT, MIN_WORDS, SYMBOL_LIMIT, TOP_LIMITS,
)
from .repeats import WINDOW

_WORD = r"[^\x20\x09-\x0D]+"
_GRAM_OVER = " OR ".join(f"n = {n} AND share > {x}" for n, x in GRAM_LIMITS.items())
_TOP_OVER = " OR ".join(f"n = {n} AND share > {x}" for n, x in TOP_LIMITS.items())
_GRAMS, _TOPS = (", ".join(map(str, x)) for x in (GRAM_LIMITS, TOP_LIMITS))

QUALITY_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
b AS MATERIALIZED (SELECT rid, len(words) AS n_words,
    coalesce(list_sum([len(w) FOR w IN words]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
u AS MATERIALIZED (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
g AS MATERIALIZED (SELECT rid, n, s, gram, count(*) OVER same AS held,
    row_number() OVER (PARTITION BY rid, n, gram ORDER BY s) AS nth
  FROM (SELECT rid, n, s, array_to_string(words[s:s + n - 1], ' ') AS gram
        FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS s
              FROM d, (SELECT unnest(range(2, {max(GRAM_LIMITS) + 1})) AS n)))
  WINDOW same AS (PARTITION BY rid, n, gram)),
again AS (SELECT DISTINCT rid, n, unnest(range(s, s + n)) AS pos FROM g
          WHERE nth > 1 AND n IN ({_GRAMS})),
inside AS (SELECT rid, n, sum(len(word))::DOUBLE / any_value(word_chars) AS share
           FROM again JOIN u USING (rid, pos) JOIN b USING (rid) GROUP BY 1, 2),
grams AS (SELECT rid, max(share) AS gram_share, bool_or({_GRAM_OVER}) AS over FROM inside GROUP BY 1),
most AS (SELECT rid, n, max(held * (len(gram) - n + 1))::DOUBLE / any_value(word_chars) AS share
         FROM g JOIN b USING (rid) WHERE held > 1 AND n IN ({_TOPS}) GROUP BY 1, 2),
tops AS (SELECT rid, least(max(share), 1.0) AS top_share, bool_or({_TOP_OVER}) AS over FROM most GROUP BY 1),
three AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (
    SELECT rid, unnest(range(s, s + 3)) AS pos FROM g WHERE n = 3 AND held > 1) GROUP BY 1),
l AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS nth,
        len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
lines AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines,
            coalesce(sum(chars) FILTER (nth > 1), 0) AS dup_chars FROM l WHERE chars > 0 GROUP BY 1),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gram_share, 0.0) AS gram_share,
    coalesce(top_share, 0.0) AS top_share,
    coalesce(n_dup_lines::DOUBLE / n_lines, 0.0) AS line_share,
    CASE WHEN word_chars > 0 THEN dup_chars::DOUBLE / word_chars ELSE 0.0 END AS line_char_share,
    n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    coalesce(grams.over, false) OR coalesce(tops.over, false)
      OR n_symbols > {SYMBOL_LIMIT} * n_words::DOUBLE AS over
  FROM d JOIN b USING (rid) LEFT JOIN grams USING (rid) LEFT JOIN tops USING (rid)
  LEFT JOIN three USING (rid) LEFT JOIN lines USING (rid))
SELECT * EXCLUDE (over), NOT (base_failed OR over OR line_share > {LINE_LIMIT}
  OR line_char_share > {LINE_CHAR_LIMIT}) AS kept FROM m
"""

REPEATS_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words
                        FROM documents),
w AS (SELECT doc_id, s, array_to_string(words[s:s + {WINDOW - 1}], ' ') AS seq
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS s FROM d)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS pos FROM f WHERE nth > 1),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
k AS (SELECT doc_id, count(gone.pos) AS n_removed,
        string_agg(word, ' ' ORDER BY u.pos) FILTER (gone.pos IS NULL) AS kept
      FROM u LEFT JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
