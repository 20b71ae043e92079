"""Reports, models, names, writers and set operations over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import keys
from tracklake.operators import alignment, cloud, reports, tables, trajectory
from tracklake.operators.pairs import checkpointed
from tracklake.plans.jump_sql import _BY_FRAME, _STEPS, _gradient
from tracklake.plans.registry import query
from tracklake.plans.space_queries import rounded
from tracklake.plans.time_queries import _by_frame
from tracklake.plans.trajectory_queries import _WINDOWS, _windows
from tracklake.sources import readers
from tracklake.sources.bindings import POINTS_SQL, STREAM_SQL, TRACK_SQL, points, stream, table, track

c = F.col


# ---- names and times

@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL
  ELSE (1700000000 + o_orderkey)::BIGINT * 1000000000 + o_custkey END AS t_ns FROM orders""")
def src3_file_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with a nanosecond part out of range, or without one, have no stamp."""
    part = F.when(c("o_orderkey") % 7 == 0, "1234567890").otherwise(c("o_custkey").cast("string"))
    name = F.concat(F.lit("left/"), (1_700_000_000 + c("o_orderkey")).cast("string"), F.when(c("o_orderkey") % 11 == 0, "_").otherwise("-"), part, F.lit(".png"))
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.stamp_ns(name).alias("t_ns"))


@query(f"WITH {STREAM_SQL} SELECT row_id, CAST(round_even(x * 30, 0) AS BIGINT) AS time_key, CAST(t_ns // 1000000000 AS BIGINT) AS seconds FROM stream")
def g14_time_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).select("row_id", keys.time_key(c("x")).alias("time_key"), F.floor(c("t_ns") / 1_000_000_000).cast("long").alias("seconds"))


@query(f"WITH {POINTS_SQL} SELECT id, x + 1e-12 >= 0.5 AS small, x * 1e6 + 1e-12 * 2e6 >= 2e6 AS large FROM points")
def g17_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", keys.reached(c("x"), 0.5).alias("small"), keys.reached(c("x") * 1e6, 2e6).alias("large"))


# ---- writers

@query("SELECT o_orderstatus AS status, count(*) AS n, true AS refused FROM orders GROUP BY 1")
def snk1_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders published once, read back by partition; publishing again to the same place is refused."""
    checkpointed(spark.range(1))  # names the shared folder
    rows = table(spark, sf_dir, "orders").select("o_orderkey", c("o_orderstatus").alias("status"))
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/published-{uuid.uuid4().hex}"
    readers.publish(rows, path, "status")
    try:
        readers.publish(rows, path, "status")
        refused = False
    except Exception as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query(f"""WITH {TRACK_SQL} SELECT segment_id, frame, printf('%.12g', x) AS prior_x, printf('%.12g', y) AS prior_y, printf('%.12g', 0.0::DOUBLE) AS prior_z,
  printf('%.12g', x / 8) AS refined_x, printf('%.12g', y * 1048576) AS refined_y, printf('%.12g', var / 1024) AS refined_z FROM track""")
def snk2_trajectory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    prior = rows.select("segment_id", "frame", F.lit("prior").alias("label"), "x", "y", F.lit(0.0).alias("z"))
    refined = rows.select("segment_id", "frame", F.lit("refined").alias("label"), (c("x") / 8).alias("x"), (c("y") * 1048576).alias("y"), (c("var") / 1024).alias("z"))
    return readers.trajectory_lines(prior.union(refined), "label", ["prior", "refined"], "segment_id", "frame")


# ---- overlaps of windows

_DIFFERENCES = f"""{TRACK_SQL}, {_WINDOWS},
d AS (SELECT a.segment_id, a.window_id AS first_window, a.frame, abs(b.x - a.x) AS center_m, degrees(abs(b.x - a.x)) AS rotation_deg
  FROM p a JOIN p b ON a.segment_id = b.segment_id AND a.frame = b.frame AND b.window_id = a.window_id + 1)"""


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows' poses are turned about z by their x."""
    poses = _windows(spark, sf_dir).withColumns({"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(c("x") / 2), "qw": F.cos(c("x") / 2)})
    values = ["x", "y", "z", "qx", "qy", "qz", "qw"]
    a = poses.select("segment_id", c("window_id").alias("first_window"), "frame", *[c(v).alias(f"a_{v}") for v in values])
    b = poses.select("segment_id", (c("window_id") - 1).alias("first_window"), "frame", *[c(v).alias(f"b_{v}") for v in values])
    return reports.overlap_differences(a.join(b, ["segment_id", "first_window", "frame"]))


@query(f"""WITH {_DIFFERENCES},
g AS (SELECT segment_id, first_window, count(*) AS n, quantile_cont(center_m, 0.5) AS c1, quantile_cont(center_m, 0.95) AS c2, max(center_m) AS c3,
  quantile_cont(rotation_deg, 0.5) AS r1, quantile_cont(rotation_deg, 0.95) AS r2, max(rotation_deg) AS r3 FROM d GROUP BY 1, 2),
e AS (SELECT segment_id, first_window, unnest([
  {{'name': 'frames', 'value': n::DOUBLE, 'passed': n >= 5}}, {{'name': 'center_m_median', 'value': c1, 'passed': c1 <= 0.02}},
  {{'name': 'center_m_p95', 'value': c2, 'passed': c2 <= 0.03}}, {{'name': 'center_m_max', 'value': c3, 'passed': c3 <= 0.005}},
  {{'name': 'rotation_deg_median', 'value': r1, 'passed': r1 <= 1.0}}, {{'name': 'rotation_deg_p95', 'value': r2, 'passed': r2 <= 0.3}},
  {{'name': 'rotation_deg_max', 'value': r3, 'passed': r3 <= 2.0}}]) AS u FROM g)
SELECT segment_id, first_window, u.name AS name, round(u.value, 5) AS value, u.passed AS passed FROM e""")
def a38_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.overlap_report(_differences(spark, sf_dir), 5, (0.02, 0.03, 0.005), (1.0, 0.3, 2.0))
    return out.select("segment_id", "first_window", "name", F.round("value", 5).alias("value"), "passed")


@query(f"""WITH {_DIFFERENCES} SELECT segment_id || ',' || first_window || ',' || (first_window + 1) || ',' || frame || ',' || printf('%.12g', round(center_m, 6)) || ',' || printf('%.12g', round(rotation_deg, 4)) AS line
  FROM d""")
def snk3_overlap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _differences(spark, sf_dir).withColumns({"center_m": F.round("center_m", 6), "rotation_deg": F.round("rotation_deg", 4)})
    return reports.overlap_lines(found)


# ---- tiles and points

@query(f"""WITH {POINTS_SQL}, g AS (SELECT DISTINCT floor(x / 4) AS i, floor(y / 4) AS j FROM points),
t AS (SELECT CAST(i * 1000 + j AS BIGINT) AS tile_id, i, j FROM g),
n AS (SELECT a.tile_id, b.tile_id AS neighbour, 4.0::DOUBLE AS edge FROM t a JOIN t b ON abs(a.i - b.i) + abs(a.j - b.j) = 1)
SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY edge DESC, neighbour) AS rank FROM n""")
def j16_adjacent_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores are the cells of four metres that hold points."""
    cells = points(spark, sf_dir).select(F.floor(c("x") / 4).alias("i"), F.floor(c("y") / 4).alias("j")).distinct()
    core = {f"{side}_{axis}": (c(cell) + step) * 4.0 for axis, cell in (("u", "i"), ("v", "j")) for side, step in (("lo", 0), ("hi", 1))}
    return cloud.adjacent_tiles(cells.select((c("i") * 1000 + c("j")).cast("long").alias("tile_id"), *[v.alias(k) for k, v in core.items()]))


@query()
def t3_point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred points, the same ones whatever the partitioning."""
    return cloud.hash_sample(points(spark, sf_dir).select("id", "x", "y", "z"), 100, "id")


@query(f"""WITH {POINTS_SQL}, s AS (SELECT tile, 3 * z - 1 AS u, 3 * x + 2 AS v, 3 * y AS w, x, y, z FROM points)
SELECT tile, count(*) AS n, round(sqrt((var_pop(u) + var_pop(v) + var_pop(w)) / (var_pop(x) + var_pop(y) + var_pop(z))), 6) AS scale FROM s GROUP BY 1""")
def a9_similarity_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are the points turned (axes change places), three times as large, moved."""
    rows = points(spark, sf_dir).select("tile", "x", "y", "z", (3 * c("z") - 1).alias("u"), (3 * c("x") + 2).alias("v"), (3 * c("y")).alias("w"))
    fit = alignment.rigid_fit(alignment.moments(rows, "tile"), "tile")
    return fit.select("tile", "n", F.round("scale", 6).alias("scale"))


@query(f"""WITH {TRACK_SQL}, h AS (SELECT *, {_STEPS} FROM track {_BY_FRAME}), g AS (SELECT *, {_gradient("x")} AS turn FROM h {_BY_FRAME}),
r AS (SELECT segment_id, turn, y AS speed, var * 10 * cos(x) + status * sin(x) AS along, -var * 10 * sin(x) + status * cos(x) AS across FROM g)
SELECT segment_id, round(corr(along, speed), 6) AS along_speed, round(corr(along, turn), 6) AS along_turn, round(corr(across, speed), 6) AS across_speed,
  round(corr(across, turn), 6) AS across_turn, round(CASE WHEN sum(speed * speed) > 0 THEN sum(along * speed) / sum(speed * speed) END, 6) AS latency_s FROM r GROUP BY 1""")
def a36_motion_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumns({"course": c("x"), "speed": c("y"), "ex": c("var") * 10, "ey": c("status").cast("double")})
    out = trajectory.motion_correlations(rows, _by_frame(), "segment_id", "t_ns")
    return out.select("segment_id", *rounded(along_speed=c("along_speed"), along_turn=c("along_turn_rate"), across_speed=c("across_speed"), across_turn=c("across_turn_rate"), latency_s=c("latency_s")))


@query(f"""WITH {POINTS_SQL}, o AS (SELECT CASE WHEN x > 25 THEN -1 ELSE tile END AS tile_id, count(*) AS n FROM points GROUP BY 1),
p AS (SELECT DISTINCT tile AS tile_id FROM points), r AS (SELECT DISTINCT tile AS tile_id FROM points WHERE z > -30)
SELECT (SELECT bool_and(tile_id IN (FROM r)) FROM p) AS tiles_run, (SELECT sum(n) FROM o) = (SELECT count(*) FROM points) AS all_owned,
  (SELECT bool_and(tile_id IN (SELECT tile_id FROM o)) FROM p) AS each_contributes,
  (SELECT count(DISTINCT id) = count(*) FROM points) AS views_once, (SELECT bool_and(u IS NOT NULL AND NOT isnan(u)) FROM points) AS metrics_finite""")
def a57_scene_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    planned, run = p.select(c("tile").alias("tile_id")).distinct(), p.where("z > -30").select(c("tile").alias("tile_id"))
    owned = p.groupBy(F.when(c("x") > 25, -1).otherwise(c("tile")).alias("tile_id")).agg(F.count("*").alias("n"))
    return tables.scene_completeness(planned, run, owned, p.count(), p.select(c("id").alias("view"), c("u").alias("metric")))


# ---- models

@query(f"""WITH {POINTS_SQL}, q AS (SELECT * FROM points UNION ALL SELECT * FROM points WHERE id % 13 = 0), n AS (SELECT id, count(*) AS n FROM q GROUP BY 1)
SELECT 'p' || q.id AS name, round(x, 6) AS x, CASE WHEN q.id % 5 = 0 THEN 'not cartesian' WHEN abs(u) * abs(v) < w * w THEN 'not semidefinite'
  WHEN n > 1 THEN 'repeated' END AS problem FROM q JOIN n USING (id) WHERE q.id % 3 > 0""")
def src7_camera_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    images = p.where("id % 3 > 0").select(c("id").alias("image_id"), F.concat(F.lit("p"), "id").alias("name"))
    system = F.when(c("id") % 5 == 0, "geodetic").otherwise("cartesian").alias("system")
    cov = {"xx": F.abs("u"), "xy": c("w"), "xz": F.lit(0.0), "yy": F.abs("v"), "yz": F.lit(0.0), "zz": F.lit(1.0)}
    priors = p.union(p.where("id % 13 = 0")).select(c("id").alias("image_id"), "x", "y", "z", system, *[v.alias(k) for k, v in cov.items()])
    return reports.camera_priors(images, priors).select("name", F.round("x", 6).alias("x"), "problem")


@query(f"""WITH {POINTS_SQL}, k AS (SELECT * FROM (VALUES ('left', 0.0::DOUBLE, 0.0::DOUBLE), ('right', 0.25::DOUBLE, -0.5::DOUBLE)) AS k(camera, b, shift)),
i AS (SELECT p.*, camera, b, shift FROM points p, k WHERE camera = 'left' OR id % 4 > 0),
t AS (SELECT id, camera, u + b AS a, cos(b) * x - sin(b) * y + shift AS tx, sin(b) * x + cos(b) * y AS ty, z AS tz FROM i)
SELECT id AS frame_id, camera, round(-(cos(a) * tx + sin(a) * ty), 6) AS x, round(-(-sin(a) * tx + cos(a) * ty), 6) AS y, round(-tz, 6) AS z, 1::BIGINT AS lefts FROM t""")
def src6_rig_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rigs turned about z by u at (x, y, z); the right camera is turned by a quarter and moved by half a metre."""
    p = points(spark, sf_dir)
    one, none = F.lit(1.0), F.lit(0.0)
    view = lambda a, x, y, z: F.array(F.cos(a), -F.sin(a), none, x, F.sin(a), F.cos(a), none, y, none, none, one, z, none, none, none, one)
    frames = p.select(c("id").alias("frame_id"), (c("id") % 2).alias("rig_id"), view(c("u"), c("x"), c("y"), c("z")).alias("rig_from_world"))
    rows = [(r, camera, float(b), float(s)) for r in (0, 1) for camera, b, s in (("left", 0, 0), ("right", 0.25, -0.5))]
    sensors = spark.createDataFrame(rows, "rig_id long, camera string, b double, s double").select("rig_id", "camera", view(c("b"), c("s"), none, none).alias("sensor_from_rig"))
    images = p.select(c("id").alias("frame_id"), F.explode(F.when(c("id") % 4 > 0, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("left")))).alias("camera"))
    out = reports.rig_trajectory(sensors, frames, images.withColumn("name", F.concat_ws("/", "camera", "frame_id")))
    return out.select("frame_id", "camera", *rounded(x=c("x"), y=c("y"), z=c("z")), "lefts")


@query(f"""WITH {POINTS_SQL}, r AS (SELECT *, u - 0.1 AS a FROM points)
SELECT id, round(x + cos(a) * 0.4 - sin(a) * 0.2, 6) AS x, round(y + sin(a) * 0.4 + cos(a) * 0.2, 6) AS y, round(z - 1.5, 6) AS z,
  round(sin((a + v) / 2), 6) AS qz, round(cos((a + v) / 2), 6) AS qw FROM r""")
def g10_camera_from_antenna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings are u, mounts are turned about z by v."""
    mount = (F.lit(0.0), F.lit(0.0), F.sin(c("v") / 2), F.cos(c("v") / 2))
    center, turn = reports.camera_from_antenna((c("x"), c("y"), c("z")), c("u"), (0.4, 0.2, -1.5), mount, 0.1)
    return points(spark, sf_dir).select("id", *rounded(x=center[0], y=center[1], z=center[2], qz=turn[2], qw=turn[3]))


@query(f"""WITH {POINTS_SQL}, p AS (SELECT tile, 500 * x / (abs(z) + 1) AS pu, 500 * y / (abs(z) + 1) AS pv, 500 * (x + 0.001 * u) / (abs(z) + 1) AS ou, 500 * y / (abs(z) + 1) + v AS ov,
  500 * (x + 0.02 * w) / (abs(z) + 1) AS lu FROM points), d AS (SELECT tile, sqrt(pow(pu - ou, 2) + pow(pv - ov, 2)) AS d, abs(lu - pu) / 0.02 AS s FROM p)
SELECT tile, count(*) AS n, round(quantile_cont(d, 0.5), 5) AS median_px, round(quantile_cont(d, 0.95), 5) AS p95_px, round(quantile_cont(s, 0.5), 4) AS px_per_s FROM d GROUP BY 1""")
def a53_reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations are moved by u and v; things move along x by w metres a second."""
    deep = F.abs("z") + 1
    at = {"pu": 500 * c("x") / deep, "pv": 500 * c("y") / deep, "ou": 500 * (c("x") + 0.001 * c("u")) / deep, "ov": 500 * c("y") / deep + c("v"), "lu": 500 * (c("x") + 0.02 * c("w")) / deep, "lv": 500 * c("y") / deep}
    out = reports.reprojection_check(points(spark, sf_dir).select("tile", *[v.alias(k) for k, v in at.items()], F.lit(0.02).alias("dt_s")), "tile")
    return out.select("tile", "n", *rounded(5, median_px=c("median_px"), p95_px=c("p95_px")), *rounded(4, px_per_s=c("px_per_s")))


# ---- acceptance

_METRICS = """SELECT l_suppkey, count(DISTINCT l_orderkey) AS images, count(*) AS points, sum(l_quantity)::DOUBLE AS observations, avg(l_linenumber)::DOUBLE AS track_length,
  avg(CAST(l_quantity > 10 AS DOUBLE)) AS inlier_share, avg(l_discount)::DOUBLE AS reprojection_px, quantile_cont(l_extendedprice::DOUBLE, 0.5) AS median_m,
  quantile_cont(l_extendedprice::DOUBLE, 0.95) AS p95_m FROM lineitem WHERE {kept} GROUP BY 1"""
_LARGER, _SMALLER = ("points", "observations", "track_length", "inlier_share"), ("reprojection_px", "median_m", "p95_m")
_EIGHT = ", ".join(
    [f"{{'name': '{x}', 'value': b.{x} / CASE WHEN a.{x} <> 0 THEN a.{x} END::DOUBLE, 'least': {low}, 'most': NULL::DOUBLE}}" for x, low in (("images", 1.0), *((x, 0.9) for x in _LARGER))]
    + [f"{{'name': '{x}', 'value': b.{x} / CASE WHEN a.{x} <> 0 THEN a.{x} END::DOUBLE, 'least': NULL::DOUBLE, 'most': 1.1}}" for x in _SMALLER]
)
REFINEMENT = f"""a AS ({_METRICS.format(kept="true")}), b AS ({_METRICS.format(kept="l_linenumber <= 5")}),
e AS (SELECT a.l_suppkey, unnest([{_EIGHT}]) AS u FROM a LEFT JOIN b USING (l_suppkey)),
checked AS (SELECT l_suppkey, u.name AS name, u.value AS value, coalesce((u.least IS NULL OR u.value >= u.least) AND (u.most IS NULL OR u.value <= u.most) AND u.value IS NOT NULL, false) AS passed FROM e)"""


def _refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the first five line numbers stand for what a refinement kept."""
    rows = table(spark, sf_dir, "lineitem")

    def metrics(df: DataFrame) -> DataFrame:
        price = c("l_extendedprice").cast("double")
        # apart: beside a distinct count, Spark would keep a percentile's values for each pair of supplier and order
        images = df.select("l_suppkey", "l_orderkey").distinct().groupBy("l_suppkey").agg(F.count("l_orderkey").alias("images"))
        return df.groupBy("l_suppkey").agg(
            F.count("*").alias("points"), F.sum("l_quantity").cast("double").alias("observations"), F.avg("l_linenumber").alias("track_length"),
            F.avg((c("l_quantity") > 10).cast("double")).alias("inlier_share"), F.avg("l_discount").cast("double").alias("reprojection_px"), F.percentile(price, 0.5).alias("median_m"), F.percentile(price, 0.95).alias("p95_m"),
        ).join(images, "l_suppkey", "left")

    return reports.refinement_acceptance(metrics(rows), metrics(rows.where("l_linenumber <= 5")), 0.1, "l_suppkey")


@query(f"WITH {REFINEMENT} SELECT l_suppkey, name, round(value, 6) AS value, passed FROM checked")
def a49_refinement_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refinement(spark, sf_dir).select("l_suppkey", "name", F.round("value", 6).alias("value"), "passed")


_SUBMAP = f"""{TRACK_SQL}, s AS (SELECT segment_id, avg(CAST(status >= 0 AS DOUBLE)) AS share, max(var) AS var FROM track GROUP BY 1),
k AS (SELECT segment_id, frame, abs(x - lag(x) OVER w) AS step FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY frame)), m AS (SELECT segment_id, max(step) AS step FROM k GROUP BY 1),
each AS (SELECT segment_id, unnest([{{'name': 'registered', 'passed': coalesce(share >= 0.7, false)}}, {{'name': 'variance', 'passed': coalesce(var <= 0.0099, false)}}, {{'name': 'step', 'passed': coalesce(step <= 4, false)}}]) AS u FROM s JOIN m USING (segment_id))"""
_VERDICT = "count(*) AS n_checks, count(*) FILTER (NOT u.passed) AS n_failed, coalesce(string_agg(CASE WHEN NOT u.passed THEN u.name END, ',' ORDER BY u.name), '') AS failed"


def _submap_checks(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    from tracklake.operators.checks import checks

    rows = track(spark, sf_dir)
    found = rows.groupBy("segment_id").agg(F.avg((c("status") >= 0).cast("double")).alias("share"), F.max("var").alias("var"))
    steps = rows.withColumn("step", F.abs(c("x") - F.lag("x").over(_by_frame()))).groupBy("segment_id").agg(F.max("step").alias("step"))
    return [checks(found, ["segment_id"], {"registered": (c("share"), 0.7, None), "variance": (c("var"), None, 0.0099)}), checks(steps, ["segment_id"], {"step": (c("step"), None, 4.0)})]


@query(f"WITH {_SUBMAP} SELECT segment_id, {_VERDICT}, count(*) FILTER (NOT u.passed AND u.name <> 'variance') = 0 AS accepted FROM each GROUP BY 1")
def a58_submap_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of registration, steps and variance together; variance is advisory."""
    return reports.acceptance(_submap_checks(spark, sf_dir), ["variance"], "segment_id")


@query(f"""WITH {_SUBMAP}, v AS (SELECT segment_id, count(*) FILTER (NOT u.passed AND u.name <> 'variance') = 0 AS accepted FROM each GROUP BY 1),
f AS (SELECT segment_id, count(*) = max(frame) + 1 AS whole FROM track GROUP BY 1),
x AS (SELECT segment_id % 10 AS field, unnest([{{'name': 'submaps', 'passed': bool_and(accepted)}}, {{'name': 'frames', 'passed': bool_and(whole)}}, {{'name': 'enough', 'passed': count(*) >= 3}}]) AS u FROM v JOIN f USING (segment_id) GROUP BY 1)
SELECT field, {_VERDICT}, count(*) FILTER (NOT u.passed) = 0 AS accepted FROM x GROUP BY 1""")
def a59_assembly_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten fields of segments: all submaps accepted, every frame there once, enough submaps."""
    from tracklake.operators.checks import checks

    submaps = reports.acceptance(_submap_checks(spark, sf_dir), ["variance"], "segment_id").select("segment_id", c("accepted").cast("int").alias("accepted"))
    frames = track(spark, sf_dir).groupBy("segment_id").agg((F.count("*") == F.max("frame") + 1).cast("int").alias("whole"))
    fields = submaps.join(frames, "segment_id").groupBy((c("segment_id") % 10).alias("field")).agg(F.min("accepted").alias("accepted"), F.min("whole").alias("whole"), F.count("*").alias("n"))
    gates = {"submaps": (c("accepted"), 1, None), "frames": (c("whole"), 1, None), "enough": (c("n"), 3, None)}
    return reports.acceptance([checks(fields, ["field"], gates)], [], "field")


# ---- sets

@query("SELECT l_orderkey FROM lineitem WHERE l_quantity < 10 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05")
def s3_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.where("l_quantity < 10").select("l_orderkey").subtract(rows.where("l_discount > 0.05").select("l_orderkey"))


@query(f"WITH {POINTS_SQL} SELECT tile, count(DISTINCT (floor(x / 5), floor(y / 5))) AS cells FROM points GROUP BY 1")
def s4_distinct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("tile", F.floor(c("x") / 5).alias("i"), F.floor(c("y") / 5).alias("j")).distinct().groupBy("tile").agg(F.count("*").alias("cells"))


@query(f"""WITH {POINTS_SQL} SELECT tile, id, row_number() OVER (PARTITION BY tile ORDER BY id) - 1 AS place
  FROM points
  WHERE x > 0
  UNION ALL SELECT tile, id, -1
  FROM points
  WHERE x <= 0""")
def s5_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile's kept rows numbered, and what it dropped."""
    p = points(spark, sf_dir)
    kept = p.where("x > 0").select("tile", "id", (F.row_number().over(Window.partitionBy("tile").orderBy("id")) - 1).cast("long").alias("place"))
    return kept.unionByName(p.where("not x > 0").select("tile", "id", F.lit(-1).cast("long").alias("place")))

