"""Check SQL of the archives: equal payloads by their text, SHA-1 in base 32 bit by bit."""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
k AS (SELECT payload, max(page_id) AS kept,
        rtrim(list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(sha1(payload), 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1, 1)
          FOR i IN range(32)], 'string_agg', '')) AS digest
      FROM p GROUP BY payload)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM p JOIN k USING (payload)
"""
