"""Check SQL of the license scan: phrases word by word, and every block against every template."""

from .licenses import BASE, CLASSES, CONTAINED, NEEDED, WORD, templates

_T = ",\n  ".join("('{}', {}, [{}], [{}]::VARCHAR[])".format(label, size, *(", ".join(f"'{w}'" for w in some)
                  for some in (words, NEEDED.get(label, ())))) for label, size, words in templates())
_V = ", ".join(f"'{w}'" for w in sorted({w for _, _, words in templates() for w in words}))
_P = ",\n  ".join("('{}', [{}])".format(label, ", ".join(f"'{w}'" for w in phrase.split()))
                  for phrase, label in BASE)
_C = ", ".join(f"({c})" for c in CLASSES)

LICENSE_SQL = rf"""
WITH t(label, class, words, musts) AS (VALUES {_T}),
p(label, words) AS (VALUES {_P}),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
u AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
b AS (SELECT rid, p.label, pos FROM u JOIN p ON u.word = p.words[1] JOIN d USING (rid)
      WHERE d.w[pos + 1:pos + len(p.words)] = p.words),
k AS (SELECT rid, word, pos FROM u WHERE word IN ({_V})),
g AS (SELECT rid, class, block, list(DISTINCT word) AS own FROM (
        SELECT rid, word, class, pos // class - back AS block
        FROM k, (VALUES {_C}) c(class), (VALUES (0), (1)) o(back)) GROUP BY ALL),
v AS (SELECT a.label AS one, b.label AS two FROM t a JOIN t b ON a.label <> b.label
  AND len(list_intersect(a.words, b.words)) >= {CONTAINED} * least(len(a.words), len(b.words)) - 1e-9),
h AS MATERIALIZED (SELECT rid, class, block, label, len(list_intersect(own, words)) AS shared,
        len(list_intersect(own, words)) / len(words) AS share
      FROM g JOIN t USING (class)
      WHERE len(list_intersect(own, words)) >= {CONTAINED} * len(words) - 1e-9
        AND len(list_intersect(own, musts)) = len(musts)),
x AS (SELECT DISTINCT a.rid, a.class, a.block, a.label FROM h a JOIN h b USING (rid, class, block)
      JOIN v ON v.one = a.label AND v.two = b.label WHERE b.shared > a.shared),
m AS (SELECT rid, label, max(share) AS share FROM h ANTI JOIN x USING (rid, class, block, label)
      GROUP BY rid, label),
s AS (SELECT rid, max(share) AS share FROM m GROUP BY rid),
l AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (
        SELECT rid, label FROM m UNION SELECT rid, label FROM b) GROUP BY rid),
a AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM b GROUP BY rid),
n AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS base_labels
      FROM (SELECT DISTINCT rid, label FROM b) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN a USING (rid) LEFT JOIN n USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""
