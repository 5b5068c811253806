"""Check SQL of the mix, written from its definition: sort, add up, take the nearest."""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|'
                             || coalesce(md5(text), '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total,
             row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k
      FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM s),
-- With the sources that are full at a level left out, the level that spends the rest.
l AS (SELECT a.k, a.total * 2 / a.weight AS ratio,
             ((SELECT sum(total) FROM w) * 1.5
              - coalesce(sum(b.total * 2) FILTER (b.total * 2 / b.weight < a.total * 2 / a.weight), 0))
             / sum(b.weight) FILTER (b.total * 2 / b.weight >= a.total * 2 / a.weight) AS here
      FROM w a, w b GROUP BY a.k, a.total, a.weight),
t AS (SELECT w.source, w.total,
             least(2 * w.total, w.weight * (SELECT max(here) FROM l WHERE here <= ratio)) AS target
      FROM w),
b AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS base
      FROM t),
p AS (SELECT source, place, sum(size) AS held FROM d GROUP BY source, place),
c AS (SELECT p.source, p.place, p.held, b.target - b.base * b.total AS rest,
             sum(p.held) OVER (PARTITION BY p.source ORDER BY p.place) - p.held AS before
      FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(b.total AS BIGINT) AS source_size, b.target,
       CAST(d.size * (b.base + CASE WHEN c.before + c.held <= c.rest
                 OR c.before <= c.rest AND c.before + c.held - c.rest < c.rest - c.before
            THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.place = c.place
"""
