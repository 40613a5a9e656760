"""SQL of the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_RANKS = """
WITH valid AS (
  SELECT query_id, leg, chunk_id, min(CASE WHEN l.higher_is_better THEN -score ELSE score END) AS cost
  FROM results r JOIN score_legs l USING (leg)
  WHERE score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', '-nan') AND chunk_id IS NOT NULL AND query_id IS NOT NULL
  GROUP BY ALL
), ranked AS (
  SELECT query_id, leg, chunk_id, rank() OVER (PARTITION BY query_id, leg ORDER BY cost) AS rk FROM valid
), legs AS (
  SELECT query_id, leg, count(*) AS n FROM valid GROUP BY ALL
), filled AS (
  SELECT c.query_id, c.chunk_id, CAST(coalesce(r.rk, l.n + 1) AS DOUBLE) AS rk, r.rk IS NOT NULL AS own
  FROM (SELECT DISTINCT query_id, chunk_id FROM valid) c JOIN legs l USING (query_id)
  LEFT JOIN ranked r ON r.query_id = c.query_id AND r.chunk_id = c.chunk_id AND r.leg = l.leg
), scored AS (
  SELECT query_id, chunk_id, median(rk) AS median_rank, avg(rk) AS mean_rank, CAST(sum(own::INT) AS INT) AS legs
  FROM filled GROUP BY ALL
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, chunk_id) AS INT) AS position FROM scored
)
"""

ORACLE = {
    "p2_ranking": _RANKS + "SELECT query_id, chunk_id, round(median_rank, 6) AS median_rank, round(mean_rank, 6) AS mean_rank, legs, position FROM placed",
    "p2_found": _RANKS + "SELECT query_id, chunk_id FROM placed WHERE position <= 5",
    "p5_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1500",
}
