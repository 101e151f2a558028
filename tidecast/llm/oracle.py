"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

# crc32 (the reflected polynomial 0xEDB88320, a byte at a time) is not a DuckDB function; conversations
# are lists of turns, nodes their distinct prefixes, and a node's smallest member stands for its path.
OP12 = r"""
WITH RECURSIVE steps AS (
  SELECT b, 0 AS i, b AS v FROM range(256) AS t(b)
  UNION ALL
  SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE i < 8
), byte_table AS (
  SELECT list(v ORDER BY b) AS t FROM steps WHERE i = 8
), convs AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), coded AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(c::VARCHAR) + 1),
    lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
  FROM convs, byte_table
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS said, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), line AS (
  SELECT c, 0 AS part, pos, role, said FROM coded JOIN turns ON conv_id = base WHERE pos < h
  UNION ALL
  SELECT c, 1, pos, role, said FROM coded JOIN turns ON conv_id = c WHERE pos >= h
), members AS (
  SELECT c, row_number() OVER w AS d, list({'r': role, 's': said}) OVER w AS path, strlen(said) AS size
  FROM line WINDOW w AS (PARTITION BY c ORDER BY part, pos)
  UNION ALL
  SELECT c, 0, [], 0 FROM convs
), nodes AS (
  SELECT path, d, min(c) AS low, count(*) AS n, any_value(size) AS size FROM members GROUP BY path, d
), children AS (
  SELECT path[:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT m.path, sum((v.n - 1) * v.size) AS saved, sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes v LEFT JOIN children k ON k.path = v.path JOIN members m ON m.c = v.low AND m.d <= v.d GROUP BY m.path
), ends AS (
  SELECT m.path, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) AS ids
  FROM members m JOIN (SELECT c, max(d) AS d FROM members GROUP BY c) z ON z.c = m.c AND z.d = m.d GROUP BY m.path
)
SELECT v.low AS conv_id, v.d AS depth, u.low AS parent_conv_id, v.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v JOIN below b ON b.path = v.path LEFT JOIN nodes u ON v.d > 0 AND u.path = v.path[:v.d - 1]
LEFT JOIN children k ON k.path = v.path LEFT JOIN ends e ON e.path = v.path
"""

OP13 = r"""
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM part a JOIN part b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank,
       s.vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES = {"op5_exact_dedup": OP5, "op12_prefix_trie": OP12, "op13_hard_negatives": OP13}
