"""Queries of this subpackage as SQL for DuckDB, where SQL can express them. Brute force: no seeds, no directory."""

from __future__ import annotations


def decontamination(share: float = 0.6, stretch: int = 12, least: int = 3) -> str:
    """Every token of a document laid on every equal one of an item. On a diagonal with its m-th equal token at place q
    of the item, a stretch from the i-th to the j-th equal token scores (3 j - 2 q_j) - (3 i - 2 q_i) + 1."""
    return rf"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS w FROM documents
), said AS (
  SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM words
), items AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS w FROM benchmark
  ) WHERE len(w) >= {least} GROUP BY w
), asked AS (
  SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS q FROM items
), laid AS (
  SELECT doc_id, item_id, n, p - q AS diagonal, q, row_number() OVER on_it AS j, count(*) OVER (PARTITION BY doc_id, item_id, p - q) AS m
  FROM said JOIN asked USING (t) WINDOW on_it AS (PARTITION BY doc_id, item_id, p - q ORDER BY q)
), rated AS (
  SELECT doc_id, item_id, n, diagonal, m, 3 * j - 2 * q AS a, min(3 * j - 2 * q) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q ROWS UNBOUNDED PRECEDING) AS least_a
  FROM laid WHERE m >= {stretch} OR m >= {share} * n OR (n < 10 AND m >= n - 1)
), best AS (
  SELECT doc_id, item_id, n, diagonal, m, max(a - least_a) + 1 AS stretch FROM rated GROUP BY ALL
), kept AS (
  SELECT * FROM best WHERE CASE WHEN n < 5 THEN m = n WHEN n < 10 THEN m >= n - 1 ELSE m >= {share} * n OR stretch >= {stretch} END
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, diagonal) AS place_of FROM kept
)
SELECT doc_id, item_id, CAST(diagonal AS BIGINT) AS place, CAST(m AS BIGINT) AS n_match, CAST(n AS BIGINT) AS n_item FROM ranked WHERE place_of = 1
"""


def sharding(limit: int) -> str:
    """For tables whose ids differ: each document's shard is the shortest prefix of its 60 bits that fits."""
    return f"""
WITH keyed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits
  FROM documents
), depths AS (
  SELECT unnest(range(0, 61)) AS depth
), nodes AS (
  SELECT depth, substr(bits, 1, depth) AS node, sum(n_bytes) AS b, count(*) AS r FROM keyed, depths GROUP BY ALL
), fitting AS (
  SELECT doc_id, n_bytes, depth, node, b, r, min(depth) OVER (PARTITION BY doc_id) AS least
  FROM keyed CROSS JOIN depths JOIN nodes USING (depth) WHERE substr(bits, 1, depth) = node AND (b <= {limit} OR r = 1)
)
SELECT doc_id, n_bytes, node AS shard, CAST(depth AS INT) AS shard_depth, CAST(b AS BIGINT) AS shard_bytes, CAST(r AS BIGINT) AS shard_docs FROM fitting WHERE depth = least
"""
