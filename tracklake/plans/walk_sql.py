"""SQL of walks that carry a state: recursions of one step a row, for all keys at once."""

from __future__ import annotations


def pairs_sql(rows: str, tolerance: int) -> str:
    """The two-pointer walk as a recursion: one step looks at the next reference and the next sample of every key.

    ``rows``: a relation of segment_id, side, t, i.
    """
    return f"""q AS (SELECT segment_id, side, t, i, row_number() OVER (PARTITION BY segment_id, side ORDER BY t, i) AS place FROM {rows}),
walk(segment_id, a, b, i, t, sample_index, d) AS (
  SELECT DISTINCT segment_id, 1::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM q
  UNION ALL
  SELECT w.segment_id, w.a + CAST(s.t - r.t >= -{tolerance} AS BIGINT), w.b + CAST(s.t - r.t <= {tolerance} AS BIGINT), r.i, r.t, s.i, s.t - r.t
  FROM walk w JOIN q r ON r.segment_id = w.segment_id AND r.side = 0 AND r.place = w.a JOIN q s ON s.segment_id = w.segment_id AND s.side = 1 AND s.place = w.b),
met AS (SELECT segment_id, i, t, sample_index, d AS residual_ns FROM walk WHERE abs(d) <= {tolerance})"""


def decimated_sql(rows: str, interval: int) -> str:
    """Each row's next row at least an interval later, followed from the first one. ``rows``: segment_id, t, i."""
    return f"""first AS (SELECT segment_id, t, min(i) AS i FROM {rows} GROUP BY 1, 2),
later AS (SELECT segment_id, t, min(t) OVER (PARTITION BY segment_id ORDER BY t RANGE BETWEEN {interval} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_t FROM first),
successor AS (SELECT a.segment_id, a.t, next_t, b.i AS next_i FROM later a JOIN first b ON a.segment_id = b.segment_id AND a.next_t = b.t),
walk(segment_id, t, i) AS (
  SELECT segment_id, min(t), arg_min(i, t) FROM first GROUP BY 1
  UNION ALL
  SELECT s.segment_id, s.next_t, s.next_i FROM walk w JOIN successor s ON s.segment_id = w.segment_id AND s.t = w.t)"""
