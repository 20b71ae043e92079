"""SQL of courses, tilts, headings and jumps for the queries over the events' tracks."""

from __future__ import annotations

from tracklake.sources.bindings import STREAM_SQL, TRACK_SQL

_JUMPS = f"""{TRACK_SQL},
r AS (SELECT segment_id, frame, t_ns, x, y, status >= 0 AS valid, var / 100 AS var FROM track),
d AS (
  SELECT *, (t_ns - lag(t_ns) OVER w) / 1e9 AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, sqrt(var + lag(var) OVER w) AS sd
  FROM r WINDOW w AS (PARTITION BY segment_id ORDER BY t_ns, frame)
),
v AS (SELECT *, CASE WHEN dt > 0 THEN dx / dt END AS vx, CASE WHEN dt > 0 THEN dy / dt END AS vy FROM d),
e AS (
  SELECT *, dx - (quantile_cont(vx, 0.5) OVER b + quantile_cont(vx, 0.5) OVER a) / 2 * dt AS rx,
    dy - (quantile_cont(vy, 0.5) OVER b + quantile_cont(vy, 0.5) OVER a) / 2 * dt AS ry,
    count(*) OVER o AS n, sum(CAST(NOT valid AS INTEGER)) OVER o AS bad, max(dt) OVER s AS slow
  FROM v WINDOW b AS (PARTITION BY segment_id ORDER BY t_ns, frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY segment_id ORDER BY t_ns, frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),
    o AS (PARTITION BY segment_id ORDER BY t_ns, frame ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING),
    s AS (PARTITION BY segment_id ORDER BY t_ns, frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
),
f AS (SELECT *, sqrt(rx * rx + ry * ry) AS residual FROM e),
g AS (SELECT * FROM f WHERE n = 12 AND bad = 0 AND slow <= 1e7 AND residual > greatest(0.075, 3 * sd, 1e-13 * dt * dt / 2)),
k AS (SELECT segment_id, frame, sum(CAST(NOT valid AS BIGINT)) OVER (PARTITION BY segment_id ORDER BY t_ns, frame) AS so_far FROM r),
h AS (
  SELECT g.*, so_far, lead(frame) OVER w AS next_frame, lead(t_ns) OVER w AS next_t, lead(rx) OVER w AS next_rx, lead(ry) OVER w AS next_ry,
    lead(residual) OVER w AS next_residual, lead(so_far) OVER w AS next_so_far
  FROM g JOIN k USING (segment_id, frame) WINDOW w AS (PARTITION BY segment_id ORDER BY t_ns, frame)
),
i AS (
  SELECT *, coalesce(next_frame > frame AND (next_t - t_ns) / 1e9 <= 1e7 AND rx * next_rx + ry * next_ry <= -0.5 * residual * next_residual
    AND sqrt(pow(rx + next_rx, 2) + pow(ry + next_ry, 2)) <= greatest(0.03, 0.9 * greatest(residual, next_residual))
    AND next_so_far = so_far AND valid, false) AS may FROM h
),
j AS (SELECT *, sum(CAST(NOT may AS BIGINT)) OVER (PARTITION BY segment_id ORDER BY t_ns, frame) AS run FROM i),
pairs AS (
  SELECT segment_id, frame AS start, next_frame AS stop
  FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, run, may ORDER BY t_ns, frame) AS place FROM j) WHERE may AND place % 2 = 1
)"""

JUMP_AUDIT = f"""WITH {_JUMPS},
s AS (SELECT segment_id, count(*) AS n FROM track GROUP BY 1),
b AS (SELECT segment_id, count(*) AS boundaries FROM g GROUP BY 1),
q AS (SELECT segment_id, count(*) AS excursions, CAST(sum(stop - start) AS BIGINT) AS rejected FROM pairs GROUP BY 1),
t AS (
  SELECT segment_id, n, coalesce(boundaries, 0) AS boundaries, coalesce(excursions, 0) AS excursions, coalesce(rejected, 0) AS rejected
  FROM s LEFT JOIN b USING (segment_id) LEFT JOIN q USING (segment_id)
)
SELECT *, boundaries - 2 * excursions AS unpaired, rejected <= 0.05 * n AND boundaries - 2 * excursions <= 0 AS passed FROM t"""

TEMPORAL_FILTER = f"""WITH {_JUMPS}
SELECT segment_id, frame, CASE WHEN NOT valid THEN 'position_invalid'
  WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.segment_id = r.segment_id AND r.frame >= p.start AND r.frame < p.stop) THEN 'paired_excursion'
  ELSE 'used' END AS reason FROM r"""


def _box(value: str) -> str:
    """A box of five rows; rows beyond the ends count as the first or last value."""
    around = f"sum({value}) OVER (PARTITION BY segment_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return (
        f"({around} + greatest(2 - frame, 0) * first_value({value}) OVER (PARTITION BY segment_id ORDER BY frame)"
        f" + greatest(frame + 3 - n, 0) * first_value({value}) OVER (PARTITION BY segment_id ORDER BY frame DESC)) / 5"
    )


def _gradient(value: str) -> str:
    """Second-order differences over uneven times from steps h0 and h1, one-sided at the ends."""
    d0, d1 = f"({value} - lag({value}) OVER w) / h0", f"(lead({value}) OVER w - {value}) / h1"
    return f"CASE WHEN h0 IS NULL THEN {d1} WHEN h1 IS NULL THEN {d0} ELSE (h1 * {d0} + h0 * {d1}) / (h0 + h1) END"


_NUMBERED = f"{TRACK_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY segment_id) AS n FROM track)"
_STEPS = "(t_ns - lag(t_ns) OVER w) / 1e9 AS h0, (lead(t_ns) OVER w - t_ns) / 1e9 AS h1"
_BY_FRAME = "WINDOW w AS (PARTITION BY segment_id ORDER BY frame)"

COURSE = f"""WITH {_NUMBERED},
s AS (SELECT *, {_box("x")} AS sx, {_box("y")} AS sy FROM c),
h AS (SELECT *, {_STEPS} FROM s {_BY_FRAME}),
g AS (SELECT segment_id, frame, {_gradient("sx")} AS vx, {_gradient("sy")} AS vy FROM h {_BY_FRAME}),
a AS (SELECT *, atan2(vy, vx) AS a, atan2(vy, vx) - lag(atan2(vy, vx)) OVER w AS d FROM g {_BY_FRAME}),
u AS (SELECT *, CASE WHEN abs(d) > pi() THEN -floor((d + pi()) / (2 * pi())) ELSE 0 END AS turns FROM a)
SELECT segment_id, frame, round(a + 2 * pi() * sum(turns) OVER (PARTITION BY segment_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 5) AS course,
  sqrt(vx * vx + vy * vy) >= 1e-5 AS course_valid FROM u"""

#: Rotations about the x axis by x: the roll is x brought within half a turn, then unwrapped.
TILT = f"""WITH {_NUMBERED},
q AS (SELECT *, sin(x / 2) AS qx, cos(x / 2) AS qw FROM c),
e AS (SELECT *, atan2(2 * qw * qx, 1 - 2 * qx * qx) AS a FROM q),
d AS (SELECT *, a - lag(a) OVER w AS d FROM e {_BY_FRAME}),
u AS (
  SELECT *, a + 2 * pi() * sum(CASE WHEN abs(d) > pi() THEN -floor((d + pi()) / (2 * pi())) ELSE 0 END)
    OVER (PARTITION BY segment_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS roll FROM d
),
s AS (SELECT segment_id, frame, {_box("roll")} AS roll FROM u),
m AS (SELECT segment_id, quantile_cont(roll, 0.5) AS m FROM s GROUP BY 1)
SELECT segment_id, frame, round(roll - m, 6) AS roll, 0.0::DOUBLE AS pitch FROM s JOIN m USING (segment_id)"""


def dual_antenna(tolerance_ns: int) -> str:
    """The second antenna (views) between the two samples around each row of the first (clicks)."""
    return f"""WITH {STREAM_SQL},
p AS (SELECT segment_id, row_id, t_ns, x, CAST(k AS DOUBLE) AS y, k % 5 > 0 AS valid FROM stream WHERE kind = 'click'),
q AS (SELECT segment_id, row_id, t_ns, x, CAST(k AS DOUBLE) AS y, CAST(k % 5 > 0 AS DOUBLE) AS ok FROM stream WHERE kind = 'view'),
l AS (SELECT p.row_id, q.t_ns AS lt, q.x AS lx, q.y AS ly, q.ok AS lok FROM p JOIN q ON q.segment_id = p.segment_id AND q.t_ns <= p.t_ns
  QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY q.t_ns DESC, q.row_id DESC) = 1),
u AS (SELECT p.row_id, q.t_ns AS ut, q.x AS ux, q.y AS uy, q.ok AS uok FROM p JOIN q ON q.segment_id = p.segment_id AND q.t_ns >= p.t_ns
  QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY q.t_ns, q.row_id) = 1),
b AS (SELECT p.*, lx, ly, lok, ux, uy, uok, CASE WHEN ut = lt THEN 0.0 ELSE (t_ns - lt) / (ut - lt) END AS f
  FROM p LEFT JOIN l USING (row_id) LEFT JOIN u ON u.row_id = p.row_id AND ut - lt <= {tolerance_ns}),
o AS (SELECT segment_id, row_id, t_ns, x, y, valid, lx + f * (ux - lx) AS ox, ly + f * (uy - ly) AS oy, lok + f * (uok - lok) AS ok FROM b),
d AS (SELECT *, sqrt(pow(ox - x, 2) + pow(oy - y, 2)) AS length_m FROM o),
g AS (SELECT *, coalesce(valid AND ok = 1 AND abs(length_m - 40.0) <= 20.0, false) AS good FROM d)
SELECT segment_id, row_id, t_ns, round(length_m, 6) AS length_m, good AS heading_valid, round(CASE WHEN good THEN atan2(oy - y, ox - x) END, 6) AS heading,
  round(CASE WHEN good THEN sqrt(0.02) / length_m END, 6) AS accuracy_rad FROM g"""
