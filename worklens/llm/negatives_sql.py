"""Check SQL of the hard negatives: every pair's product, first positives, first negatives."""

NEGATIVES_SQL = """WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
near AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id
    ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score,
  score AS negative_score
FROM near JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
