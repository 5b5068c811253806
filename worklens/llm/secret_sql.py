"""Check SQL of the secret spans: places by the pieces between matches, every window counted anew."""

from .secret_spans import (
    ACCESS, ACCESS_LEAST, ALLOW, ASSIGN, CANDIDATE, CLASSES, HEX, MIXED, SCALE, VALUE_LEAST,
    WINDOW, most_sum,
)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: str, order: int, pattern: str) -> str:
    return f"""
  SELECT doc_id, rid, '{kind}' AS kind, {order} AS o, hits[i] AS value,
         list_sum([len(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([len(x) FOR x IN hits[1:i-1]]), 0) AS a
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, rid, regexp_extract_all(text, {quoted(pattern)}) AS hits,
           string_split_regex(text, {quoted(pattern)}) AS gaps FROM d) WHERE len(hits) > 0)"""


_RUN = next(p for p in ALLOW if "\\1" in p)
_KNOWN = " OR ".join(f"regexp_matches(value, {quoted(p)})" for p in ALLOW if p != _RUN)
_MIXED = " OR ".join(f"(regexp_matches(value, {quoted(a)}) AND regexp_matches(value, {quoted(b)}))"
                     for a, b in MIXED)
_LIMIT = " ".join(f"WHEN regexp_matches(value, {quoted(p)}) THEN {most_sum(bits)}"
                  for p, bits in CLASSES[:-1])

SECRET_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
s AS ({_spans('assign', 0, ASSIGN)} UNION ALL {_spans('access', 1, ACCESS)}
      UNION ALL {_spans('hex', 2, HEX)}),
base AS (SELECT * FROM s WHERE CASE kind
    WHEN 'assign' THEN len(regexp_extract(value, {quoted(ASSIGN)}, 1)) >= {VALUE_LEAST}
    WHEN 'access' THEN len(value) >= {ACCESS_LEAST} ELSE true END),
c AS ({_spans('entropy', 3, CANDIDATE)}),
met AS (SELECT c.rid, c.a AS ca, b.a AS x, b.a + len(b.value) AS y FROM c JOIN base b
        ON b.rid = c.rid AND b.a < c.a + len(c.value) AND c.a < b.a + len(b.value)),
cuts AS (SELECT rid, ca, greatest(ca, coalesce(max(y) OVER (PARTITION BY rid, ca ORDER BY x, y
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ca)) AS s, x AS t FROM met
         UNION ALL SELECT rid, ca, greatest(ca, max(y)), NULL FROM met GROUP BY rid, ca),
part AS (SELECT c.doc_id, c.rid, kind, o, coalesce(s, c.a) AS a,
           substr(value, (coalesce(s, c.a) - c.a + 1)::BIGINT,
             (coalesce(t, c.a + len(value)) - coalesce(s, c.a))::BIGINT) AS value
         FROM c LEFT JOIN cuts ON cuts.rid = c.rid AND cuts.ca = c.a
         WHERE coalesce(t, c.a + len(value)) - coalesce(s, c.a) >= {WINDOW}),
e AS (SELECT * FROM part
      WHERE ({_MIXED})
        AND NOT ({_KNOWN})
        AND NOT list_bool_or([value[j:j+5] = repeat(value[j], 6) FOR j IN range(1, len(value) - 4)])),
w AS (SELECT *, list_min([list_sum([CAST(round(n * log2(n) * {SCALE}) AS BIGINT)
                FOR n IN map_values(list_histogram(string_split(value[j:j+{WINDOW - 1}], '')))])
              FOR j IN range(1, len(value) - {WINDOW - 2})]) AS least FROM e),
more AS (SELECT doc_id, rid, kind, o, value, a FROM w
         WHERE least <= CASE {_LIMIT} ELSE {most_sum(CLASSES[-1][1])} END),
t AS (SELECT rid, kind, o, a, kind || ':' || a || ':' || (a + len(value)) AS one FROM base
      UNION ALL SELECT rid, kind, o, a, kind || ':' || a || ':' || (a + len(value)) FROM more),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign,
             count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             count(*) FILTER (kind = 'entropy') AS n_entropy,
             string_agg(one, ',' ORDER BY a, o) FILTER (kind <> 'entropy') AS base,
             string_agg(one, ',' ORDER BY a, o) AS spans FROM t GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
