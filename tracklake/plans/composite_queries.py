"""Whole jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import composites, reports
from tracklake.plans.registry import query
from tracklake.plans.space_queries import rounded
from tracklake.plans.time_queries import BRACKET
from tracklake.plans.trajectory_queries import _WINDOWS, _windows
from tracklake.sources.bindings import POINTS_SQL, STREAM_SQL, TRACK_SQL, points, stream, track

c = F.col
_GAP = 4 * 10**14


@query(f"""WITH {STREAM_SQL}, {BRACKET}, o AS (SELECT *, upper_t_ns - lower_t_ns <= {_GAP} AS ok FROM br),
g AS (SELECT row_id, radians(40 + x / 1000) AS p, radians(5) AS q, radians(40) AS p0, x / 50 AS turn, 6378137.0::DOUBLE AS ea, 0.00669437999014::DOUBLE AS e2 FROM stream WHERE kind = 'view'),
n AS (SELECT *, ea / sqrt(1 - e2 * sin(p) * sin(p)) AS n, ea / sqrt(1 - e2 * sin(p0) * sin(p0)) AS n0 FROM g),
d AS (SELECT *, n * cos(p) * cos(q) - n0 * cos(p0) * cos(q) AS dx, n * cos(p) * sin(q) - n0 * cos(p0) * sin(q) AS dy, (n * (1 - e2)) * sin(p) - n0 * (1 - e2) * sin(p0) AS dz FROM n),
e AS (SELECT row_id, -sin(p0) * cos(q) * dx - sin(p0) * sin(q) * dy + cos(p0) * dz AS north FROM d)
SELECT o.segment_id, o.row_id, CASE WHEN ok THEN round(l.north + alpha * (u.north - l.north), 3) END AS north, CASE WHEN o.segment_id % 5 = 0 THEN 'validation' ELSE 'training' END AS role, CASE WHEN coalesce(ok, false) THEN NULL ELSE 'truth' END AS problem
FROM o LEFT JOIN e l ON l.row_id = lower_index LEFT JOIN e u ON u.row_id = upper_index""")
def c4_truth_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are a reference trajectory along a meridian, clicks are frames; every fifth recording validates."""
    truth = stream(spark, sf_dir, "view").withColumns({"lat": 40 + c("x") / 1000, "lon": F.lit(5.0), "alt": F.lit(0.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(c("x") / 100), "qw": F.cos(c("x") / 100)})
    out = composites.truth_observations(stream(spark, sf_dir, "click"), truth, (40.0, 5.0, 0.0), _GAP, c("segment_id") % 5 == 0)
    return out.select("segment_id", "row_id", F.round("y", 3).alias("north"), "role", "problem")


@query(f"""WITH {POINTS_SQL}, h AS (SELECT CASE WHEN id % 10 = 7 THEN 3.0::DOUBLE ELSE 0 END AS e, id FROM points WHERE id % 3 = 0 AND id % 11 > 0),
g AS (SELECT (SELECT avg(CAST(id % 11 > 0 AS DOUBLE)) FROM points) AS registered, quantile_cont(e, 0.5) AS median_m, quantile_cont(e, 0.95) AS p95_m, avg(CAST(e <= 0.5 AS DOUBLE)) AS share FROM h),
u AS (SELECT unnest([{{'name': 'registered', 'value': registered, 'passed': registered >= 0.9}}, {{'name': 'median_m', 'value': median_m, 'passed': median_m <= 0.1}}, {{'name': 'p95_m', 'value': p95_m, 'passed': p95_m <= 1.0}}, {{'name': 'inlier_share', 'value': share, 'passed': share >= 0.85}}]) AS u FROM g)
SELECT u.name AS name, round(u.value, 6) AS value, u.passed AS passed, (SELECT bool_and(u.passed) FROM u) AS accepted FROM u""")
def c6_pose_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points are a model's centres; priors are those turned and moved, a tenth of them three metres off."""
    p = points(spark, sf_dir).withColumn("name", F.concat(F.lit("p"), "id"))
    images = p.select("name", F.when(c("id") % 3 == 0, "holdout").otherwise("calibration").alias("role"))
    poses = p.select("name", "x", "y", "z", F.when(c("id") % 11 == 0, "repeated").alias("problem"))
    off = F.when(c("id") % 10 == 7, 3.0).otherwise(0.0)
    priors = p.select("name", (100 - c("y")).alias("x"), (c("x") + 20).alias("y"), (c("z") - 7 + off).alias("z"), F.lit(None).cast("string").alias("problem"))
    out = composites.pose_export(images, poses, priors, 0.5, 0.9, 0.1, 1.0, 0.85)
    return out.select("name", F.round("value", 6).alias("value"), "passed", "accepted")


_SHARED = f"""{TRACK_SQL}, {_WINDOWS},
o AS (SELECT a.segment_id, a.window_id + 1 AS window_id, count(*) AS n, max(a.x) - min(a.x) AS reach FROM p a JOIN p b ON a.segment_id = b.segment_id AND a.frame = b.frame AND b.window_id = a.window_id + 1 GROUP BY 1, 2),
d AS (SELECT DISTINCT segment_id, window_id FROM p)"""
_CHAIN = f"""{_SHARED},
k AS (SELECT d.segment_id, d.window_id, bool_and(d.window_id = 0 OR coalesce(n >= 3, false)) OVER (PARTITION BY d.segment_id ORDER BY d.window_id) AS chained
  FROM d LEFT JOIN o USING (segment_id, window_id))"""


@query(f"""WITH {_CHAIN}, f AS (SELECT segment_id, count(DISTINCT frame) AS n FROM p JOIN k USING (segment_id, window_id) WHERE chained GROUP BY 1)
SELECT segment_id, n, 1.0::DOUBLE AS inlier_share, 0.0::DOUBLE AS median_m, 0.0::DOUBLE AS p95_m FROM f WHERE n >= 3""")
def c9_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a track, each turned and moved by itself, in one gauge again; the global fit leaves nothing."""
    poses = _windows(spark, sf_dir).select("segment_id", "window_id", "frame", "x", "y", "z")
    a = c("window_id") * 0.3
    moved = poses.select("segment_id", "window_id", "frame", (F.cos(a) * c("x") - F.sin(a) * c("y") + c("window_id")).alias("x"), (F.sin(a) * c("x") + F.cos(a) * c("y") - 2).alias("y"), (c("z") + c("window_id") / 4).alias("z"))
    targets = track(spark, sf_dir).select("segment_id", "frame", (5 - c("y")).alias("u"), c("x").alias("v"), F.lit(1.0).alias("w"))
    out = composites.globally_fitted(composites.synchronised(moved), targets)
    return out.select("segment_id", "n", *rounded(5, inlier_share=c("inlier_share"), median_m=c("median_m"), p95_m=c("p95_m")))


def _straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a track on a straight line: centres along x alone, cameras that look ever further round; each window rolled and turned by itself."""
    poses = _windows(spark, sf_dir)
    half, look = c("window_id") * 0.2, c("frame") * 0.05
    # first rolled about x, which the centres don't show, then turned about z and moved
    s, d, a = F.sin(half), F.cos(half), c("window_id") * 0.3
    own = (F.lit(0.0), F.lit(0.0), F.sin(look), F.cos(look))
    rolled = reports.quaternion_product((s, F.lit(0.0), F.lit(0.0), d), own)
    turned = reports.quaternion_product((F.lit(0.0), F.lit(0.0), F.sin(a / 2), F.cos(a / 2)), rolled)
    x = c("x") - 0.01 * c("window_id")
    centre = ((F.cos(a) * x + c("window_id")).alias("x"), (F.sin(a) * x - 2 * c("window_id")).alias("y"), (c("window_id") / 4).alias("z"))
    return poses.select("segment_id", "window_id", "frame", "t_ns", *centre, *[v.alias(n) for v, n in zip(turned, ("qx", "qy", "qz", "qw"), strict=True)])


@query(f"""WITH {_SHARED},
k AS (SELECT d.segment_id, d.window_id, bool_and(d.window_id = 0 OR coalesce(n >= 2 AND reach > 1e-5, false)) OVER (PARTITION BY d.segment_id ORDER BY d.window_id) AS chained, d.window_id > 0 AS joined
  FROM d LEFT JOIN o USING (segment_id, window_id))
SELECT segment_id, window_id, frame, chained, CASE WHEN chained AND joined THEN 'orientations' END AS observed_by,
  CASE WHEN chained THEN round(x - 0.01 * window_id, 5) END AS x, CASE WHEN chained THEN 0.0::DOUBLE END AS y, CASE WHEN chained THEN 0.0::DOUBLE END AS z, CASE WHEN chained THEN 0.0::DOUBLE END AS turned_back
FROM p JOIN k USING (segment_id, window_id)""")
def c9_straight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose centres stand in a line, chained by the orientations of the frames they share, two frames included."""
    out = composites.synchronised(_straight(spark, sf_dir))
    # cameras look as in the first window again: no part about x and y is left, and the part about z is the frame's
    look = c("frame") * 0.05
    off = F.sqrt(F.pow("qx", 2) + F.pow("qy", 2)) + F.abs(F.cos(look) * c("qz") - F.sin(look) * c("qw"))
    return out.select("segment_id", "window_id", "frame", "chained", "observed_by", *rounded(5, x=c("x"), y=c("y"), z=c("z"), turned_back=off))
