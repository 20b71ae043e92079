"""Trajectories, contracts, registrations, readers and writers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import association, checks, series, tables, trajectory
from tracklake.plans.jump_sql import COURSE, TILT, dual_antenna
from tracklake.plans.registry import query
from tracklake.plans.space_queries import rounded
from tracklake.plans.time_queries import BRACKET, STEP, TOL, _by_frame
from tracklake.sources import readers
from tracklake.sources.bindings import POINTS_SQL, STREAM_SQL, TRACK_SQL, points, stream, table, track

c = F.col


@query(f"""WITH {TRACK_SQL},
d AS (SELECT *, {STEP} AS step, (t_ns - lag(t_ns) OVER w) / 1e9 AS dt FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY frame))
SELECT segment_id, round(1e6 / quantile_cont(dt, 0.5), 6) AS rate_uhz, round(1e6 * quantile_cont(step / dt, 0.5) FILTER (step / dt > 1e-6), 6) AS speed_um, greatest(1, CAST(floor(2.0 * (1 / quantile_cont(dt, 0.5)) / (quantile_cont(step / dt, 0.5) FILTER (step / dt > 1e-6)) + 0.5) AS BIGINT)) AS stride
  FROM d
  GROUP BY 1""")
def a5_a6_rate_speed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = trajectory.rate_and_speed(track(spark, sf_dir), _by_frame(), "segment_id", "t_ns", "x", "y", moving=1e-6)
    return r.select("segment_id", F.round(1e6 * c("rate_hz"), 6).alias("rate_uhz"), F.round(1e6 * c("speed"), 6).alias("speed_um"), trajectory.stride_for(F.lit(2.0), c("rate_hz"), c("speed")).alias("stride"))


@query(f"WITH {TRACK_SQL} SELECT segment_id, max(var) - min(var) <= 1e-9 AS static, count(DISTINCT carrier) AS kinds FROM track GROUP BY 1")
def a7_covariance_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).groupBy("segment_id").agg((F.max("var") - F.min("var") <= 1e-9).alias("static"), F.count_distinct("carrier").alias("kinds"))


@query(f"""WITH {STREAM_SQL}, {BRACKET}, v AS (SELECT br.segment_id, br.row_id, br.t_ns, lx + alpha * (ux - lx) AS fix, s.k AS own, ntile(2) OVER (PARTITION BY br.segment_id ORDER BY br.t_ns, br.row_id) AS half FROM br JOIN stream s ON s.row_id = br.row_id WHERE alpha IS NOT NULL)
SELECT segment_id, count(*) AS n, round(quantile_cont(fix, 0.5) - quantile_cont(own, 0.5), 5) AS offset_ns, round((quantile_cont(fix, 0.5) FILTER (half = 2) - quantile_cont(own, 0.5) FILTER (half = 2)) - (quantile_cont(fix, 0.5) FILTER (half = 1) - quantile_cont(own, 0.5) FILTER (half = 1)), 5) AS drift_ns FROM v GROUP BY 1""".replace("lx + alpha * (ux - lx) AS fix", "floor(lx) + alpha * (floor(ux) - floor(lx)) AS fix"))
def a4_clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda kind, delay: stream(spark, sf_dir, kind).select("segment_id", "row_id", c("t_ns").alias("log_ns"), (c("t_ns") + delay).alias("header_ns"))
    out = trajectory.clock_offset(rows("view", F.floor("x")), rows("click", c("k")))
    return out.select("segment_id", "n", *rounded(5, offset_ns=c("offset_ns"), drift_ns=c("drift_ns")))


@query(f"""WITH {TRACK_SQL},
r AS (SELECT *, abs(x - lag(x) OVER w) / ((t_ns - lag(t_ns) OVER w) / 1e9) AS rate FROM track WHERE x < 1.5 WINDOW w AS (PARTITION BY segment_id ORDER BY frame)),
f AS (SELECT *, coalesce(rate >= 1e-4, false) AS fast FROM r)
SELECT segment_id, frame, fast OR coalesce(lead(fast) OVER (PARTITION BY segment_id ORDER BY frame), false) AS turning FROM f""")
def w5_turning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles stay under pi here, so steps need no wrapping in the SQL."""
    rows = track(spark, sf_dir).where("x < 1.5")
    return trajectory.turning(rows.withColumn("yaw", c("x")), _by_frame(), "t_ns", 1e-4).select("segment_id", "frame", "turning")


@query(f"""WITH {TRACK_SQL},
t AS (SELECT * FROM track),
d AS (SELECT segment_id, frame, sqrt(pow(0.5 * (x - lag(x) OVER w), 2) + pow(0.25 * (y - lag(y) OVER w), 2)) AS v, abs(sqrt(pow(1.5 * (x - lag(x) OVER w), 2) + pow(1.25 * (y - lag(y) OVER w), 2)) - sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))) AS l
  FROM t WINDOW w AS (PARTITION BY segment_id ORDER BY frame))
SELECT segment_id, round(max(v), 6) AS vector_m, round(max(l), 6) AS length_m FROM d GROUP BY 1""")
def w18_step_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumns({"z": F.lit(0.0), "u": c("x") * 1.5, "v": c("y") * 1.25})
    out = trajectory.step_errors(rows, _by_frame(), "segment_id", "frame", ("x", "y", "z"), ("u", "v", "z"))
    return out.select("segment_id", *rounded(vector_m=c("vector_m"), length_m=c("length_m")))


@query(f"WITH {TRACK_SQL} SELECT segment_id, frame, frame % 5 = 3 AS validation FROM track")
def w26_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    held = series.every_kth(rows, _by_frame(), 5, 3).select("segment_id", "frame", F.lit(True).alias("validation"))
    return rows.select("segment_id", "frame").join(held, ["segment_id", "frame"], "left").select("segment_id", "frame", F.coalesce("validation", F.lit(False)).alias("validation"))


@query(f"WITH {STREAM_SQL}, {BRACKET} SELECT segment_id, row_id, lower_index, upper_index, round(lx + alpha * (ux - lx), 6) AS x FROM br")
def j7_interpolated_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = stream(spark, sf_dir, "view").withColumns({"y": c("k") * 1.0, "z": F.lit(0.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(c("x") / 100), "qw": F.cos(c("x") / 100)})
    out = trajectory.interpolated_poses(stream(spark, sf_dir, "click"), poses)
    return out.select("segment_id", "row_id", "lower_index", "upper_index", *rounded(x=c("x")))


@query(f"""WITH {STREAM_SQL}, {BRACKET},
v AS (SELECT *, min(k) OVER (PARTITION BY segment_id ORDER BY t_ns ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 5 AS ok FROM stream WHERE kind = 'view')
SELECT br.segment_id, br.row_id, CASE WHEN l.ok AND u.ok THEN round(lx + alpha * (ux - lx), 6) END AS x
  FROM br
  LEFT JOIN v l ON l.row_id = lower_index
  LEFT JOIN v u ON u.row_id = upper_index""")
def j8_supported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir, "view").withColumn("fine", c("k") >= 5)
    out = trajectory.supported_values(stream(spark, sf_dir, "click"), rows, ["x"], "fine", 1, None)
    return out.select("segment_id", "row_id", *rounded(x=c("x")))


_WINDOWS = "p AS (SELECT segment_id, w AS window_id, frame, t_ns, x + 0.01 * w AS x, y, 0.0::DOUBLE AS z FROM (SELECT *, unnest(list_distinct([frame // 15, greatest((frame - 5) // 15, 0)])) AS w FROM track) WHERE frame BETWEEN w * 15 AND w * 15 + 19)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("window_id", F.explode(F.array_distinct(F.array(F.floor(c("frame") / 15), F.greatest(F.floor((c("frame") - 5) / 15), F.lit(0).cast("long"))))))
    rows = rows.where(c("frame").between(c("window_id") * 15, c("window_id") * 15 + 19))
    return rows.select("segment_id", "window_id", "frame", "t_ns", (c("x") + 0.01 * c("window_id")).alias("x"), "y", F.lit(0.0).alias("z"))


@query(f"""WITH {TRACK_SQL}, {_WINDOWS} SELECT a.segment_id, a.window_id AS first_window, a.frame, round(b.x - a.x, 6) AS dx, a.t_ns = b.t_ns AS same_time
  FROM p a JOIN p b ON a.segment_id = b.segment_id AND a.frame = b.frame AND b.window_id = a.window_id + 1""")
def j19_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.overlaps(_windows(spark, sf_dir)).select("segment_id", "first_window", "frame", F.round(c("b_x") - c("a_x"), 6).alias("dx"), "same_time")


@query(f"""WITH {TRACK_SQL}, {_WINDOWS},
w AS (SELECT *, pow(least(row_number() OVER v, count(*) OVER (PARTITION BY segment_id, window_id) - row_number() OVER v + 1), 2) AS g
  FROM p WINDOW v AS (PARTITION BY segment_id, window_id ORDER BY frame))
SELECT segment_id, frame, count(*) AS windows, round(sum(g * x) / sum(g), 6) AS x, round(sum(g * y) / sum(g), 6) AS y FROM w GROUP BY 1, 2""")
def a42_blended_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.blended_centers(_windows(spark, sf_dir), 2.0).select("segment_id", "frame", "windows", *rounded(x=c("x"), y=c("y")))


@query(f"""WITH {TRACK_SQL}, {_WINDOWS},
r AS (SELECT segment_id, frame, CASE (frame + window_id) % 3 WHEN 0 THEN 'calibration' ELSE 'holdout' END AS role
  FROM p
  WHERE frame % 4 > 0
  UNION ALL SELECT segment_id, frame, 'none'
  FROM p
  WHERE frame % 4 = 0)
SELECT segment_id, frame, CASE WHEN bool_or(role = 'calibration') THEN 'calibration' WHEN bool_and(role = 'holdout') THEN 'holdout' ELSE 'excluded' END AS role
  FROM r
  GROUP BY 1, 2""")
def a40_united_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(c("frame") % 4 == 0, "none").when((c("frame") + c("window_id")) % 3 == 0, "calibration").otherwise("holdout")
    return trajectory.united_roles(_windows(spark, sf_dir).withColumn("role", role), "segment_id", "frame")


@query(f"""WITH {POINTS_SQL},
q AS (SELECT id, sqrt(pow(x - u, 2) + pow(y - v, 2) + pow(z - w, 2)) AS d FROM points)
SELECT id, round(d, 6) AS distance_m, 90.0::DOUBLE AS angle_deg FROM q""")
def a37_compare_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two poses a quarter turn apart."""
    turn = {"qx": F.lit(0.0), "qy": F.lit(0.0)}
    a = points(spark, sf_dir).select("id", "x", "y", "z").withColumns({**turn, "qz": F.lit(0.0), "qw": F.lit(1.0)})
    b = points(spark, sf_dir).select("id", c("u").alias("x"), c("v").alias("y"), c("w").alias("z")).withColumns({**turn, "qz": F.sqrt(F.lit(0.5)), "qw": F.sqrt(F.lit(0.5))})
    return trajectory.compare_poses(a, b, "id").select("id", *rounded(distance_m=c("distance_m")), *rounded(3, angle_deg=c("angle_deg")))


@query(f"""WITH {POINTS_SQL},
d AS (SELECT tile, id, sqrt(pow(x - u, 2) + pow(y - v, 2) + pow(z - w, 2)) AS d FROM points),
m AS (SELECT tile, quantile_cont(d, 0.5) AS m, count(*) AS n FROM d GROUP BY 1)
SELECT tile, any_value(n) AS n, round(any_value(m), 6) AS median_m, round(max(abs(d - m)), 6) AS max_change_m FROM d JOIN m USING (tile) GROUP BY 1""")
def a39_baseline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    poses = p.select("tile", "id", F.lit("left").alias("camera"), "x", "y", "z").union(p.select("tile", "id", F.lit("right"), "u", "v", "w"))
    return trajectory.baseline_audit(poses, "tile", "id", "camera", "left", "right").select("tile", "n", *rounded(median_m=c("median_m"), max_change_m=c("max_change_m")))


@query(f"""WITH {POINTS_SQL},
r AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM points)
SELECT tile, round(quantile_cont(r, 0.5), 6) AS median_m, round(sqrt(avg(r * r)), 6) AS rms_m, round(quantile_cont(r, 0.95), 6) AS p95_m, round(max(r), 6) AS max_m, round(sqrt(avg(x * x)), 6) AS rms_ex
  FROM r
  GROUP BY 1""")
def a31_calibration_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.calibration_score(points(spark, sf_dir).withColumns({"ex": c("x"), "ey": c("y"), "ez": c("z")}), "tile")
    return out.select("tile", *rounded(**{n: c(n) for n in ("median_m", "rms_m", "p95_m", "max_m", "rms_ex")}))


@query(f"WITH {POINTS_SQL} SELECT id, round(CASE WHEN x > 0 THEN greatest(0.3, abs(y), abs(z)) ELSE abs(u) END, 6) AS sigma FROM points")
def a34_axis_sigmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumns({"trusted": c("x") > 0, "posterior": F.abs("y"), "spread": F.abs("z"), "prior": F.abs("u")})
    return rows.select("id", *rounded(sigma=trajectory.axis_sigmas(rows, 0.3)))


@query(COURSE)
def w11_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.course(track(spark, sf_dir), _by_frame(), "segment_id", "t_ns", 5, 1e-5)
    return out.select("segment_id", "frame", F.round("course", 5).alias("course"), "course_valid")


@query(TILT)
def w27_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumns({"qx": F.sin(c("x") / 2), "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.cos(c("x") / 2)})
    return trajectory.tilt(rows, _by_frame(), "segment_id", 5).select("segment_id", "frame", F.round("roll", 6).alias("roll"), F.round("pitch", 6).alias("pitch"))


@query(dual_antenna(TOL * 20))
def w28_dual_antenna(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda kind: stream(spark, sf_dir, kind).select("segment_id", "row_id", "t_ns", "x", c("k").cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(0.01).alias("var"), (c("k") % 5 > 0).alias("valid"))
    out = trajectory.dual_antenna_heading(rows("click"), rows("view"), 40.0, 20.0, TOL * 20)
    return out.select("segment_id", "row_id", "t_ns", "heading_valid", *rounded(length_m=c("length_m"), heading=c("heading"), accuracy_rad=c("accuracy_rad")))


# ---- contracts

@query(f"""WITH {TRACK_SQL},
f AS (SELECT segment_id, frame + CASE WHEN segment_id % 9 = 0 AND frame > 20 THEN 1 ELSE 0 END AS frame, t_ns, frame AS own FROM track),
s AS (SELECT segment_id, frame FROM f WHERE NOT (segment_id % 7 = 0 AND own = 3)),
r AS (SELECT segment_id, 'frames_contiguous' AS rule FROM f WHERE frame <> own UNION ALL SELECT segment_id, 'split_covers' FROM f ANTI JOIN s USING (segment_id, frame))
SELECT segment_id, rule, count(*) AS n FROM r GROUP BY 1, 2""")
def q1_frame_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("own", c("frame"))
    rows = rows.withColumn("frame", c("frame") + F.when((c("segment_id") % 9 == 0) & (c("frame") > 20), 1).otherwise(0))
    split = rows.where(~((c("segment_id") % 7 == 0) & (c("own") == 3))).select("segment_id", "frame")
    return tables.frame_contract(rows, split)


@query(f"WITH {STREAM_SQL} SELECT segment_id, row_id FROM stream WHERE row_id % 10 IN (0, 3)")
def q2_association_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir)
    raw = rows.select("segment_id", c("row_id").alias("source_index"), "t_ns")
    late = F.when(c("row_id") % 10 == 0, 1).otherwise(0)
    seen = rows.select("segment_id", "row_id", c("row_id").alias("source_index"), (c("t_ns") - 5).alias("t_ns"), (c("t_ns") + late).alias("source_t_ns"), (5 + late + F.when(c("row_id") % 10 == 3, 1).otherwise(0)).alias("residual_ns"))
    return tables.association_contract(seen, raw).select("segment_id", "row_id")


@query(f"WITH {POINTS_SQL} SELECT id, id % 5 > 0 AS valid FROM points")
def q4_pose_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.functions import rotation

    r = rotation.matrix(rotation.normalized((c("u"), c("v"), c("w"), F.lit(1.0))))
    bent = F.when(c("id") % 5 == 0, 1.01).otherwise(1.0)
    # the whole row: an entry alone may be 0, and stretching it changes nothing
    m = (*[x * bent for x in r[:3]], c("x"), *r[3:6], c("y"), *r[6:9], c("z"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    rows = points(spark, sf_dir).select("id", *[x.alias(f"m{k}") for k, x in enumerate(m)])
    return rows.select("id", tables.pose_valid(tuple(c(f"m{k}") for k in range(16))).alias("valid"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'imu' WHEN 'F' THEN '' ELSE 'fix,imu' END AS lacking, o_orderkey % 50 = 0 AS empty
  FROM orders
  WHERE o_orderstatus <> 'F' OR o_orderkey % 50 = 0""")
def q6_topics_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.when(c("o_orderstatus") == "O", F.array(F.lit("fix"), F.lit("left"))).when(c("o_orderstatus") == "F", F.array(F.lit("imu"), F.lit("fix"))).otherwise(F.array(F.lit("left")))
    chunks = table(spark, sf_dir, "orders").select("o_orderkey", have.alias("topics"), F.lit(100).alias("start_ns"), (100 + c("o_orderkey") % 50).alias("stop_ns"))
    return tables.topics_missing(chunks, ["fix", "imu"], "o_orderkey")


@query(f"""WITH {TRACK_SQL}, {_WINDOWS},
l AS (SELECT segment_id, window_id, frame, CASE WHEN frame % 2 = 0 THEN 'calibration' ELSE 'holdout' END AS role FROM p)
SELECT segment_id, window_id, frame, CASE WHEN frame % 11 = 0 THEN 'rejected' ELSE 'holdout calibrates' END AS problem
  FROM l
  WHERE frame % 11 = 0 OR (frame % 3 = 0 AND role = 'calibration')""")
def q9_leaking_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = _windows(spark, sf_dir).withColumn("role", F.when(c("frame") % 2 == 0, "calibration").otherwise("holdout"))
    rows = track(spark, sf_dir)
    overall = rows.select("segment_id", "frame", F.when(c("frame") % 3 == 0, "holdout").otherwise("calibration").alias("role"))
    return tables.leaking_roles(local, overall, rows.where("frame % 11 = 0"), "segment_id", "frame").select("segment_id", "window_id", "frame", "problem")


@query("""WITH e AS (SELECT DISTINCT l_returnflag, l_partkey AS name FROM lineitem WHERE l_quantity < 25),
r AS (SELECT DISTINCT l_returnflag, l_partkey AS name FROM lineitem WHERE l_quantity > 20),
j AS (SELECT l_returnflag, e.name IS NOT NULL AS e, r.name IS NOT NULL AS r
  FROM (SELECT *, name AS k
  FROM e) e
  FULL JOIN (SELECT *, name AS k
  FROM r) r USING (l_returnflag, k))
SELECT l_returnflag, count(*) FILTER (e) AS n_expected, count(*) FILTER (r) AS n_registered, count(*) FILTER (NOT r) AS n_missing, count(*) FILTER (NOT e) AS n_unexpected, round(count(*) FILTER (e AND r) / count(*) FILTER (e), 9) AS share
  FROM j
  GROUP BY 1""")
def a13_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", c("l_partkey").alias("name"), "l_quantity")
    return tables.registration(rows.where("l_quantity < 25"), rows.where("l_quantity > 20"), "name", "l_returnflag").withColumn("share", F.round("share", 9))


@query("""WITH n AS (SELECT l_suppkey, l_partkey, count(*) AS n, count(DISTINCT l_linenumber) AS cameras FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, n, CASE WHEN n > cameras THEN 'duplicate' WHEN cameras = 2 THEN 'complete' WHEN cameras = 1 THEN 'singleton' ELSE 'partial' END AS state
  FROM n""")
def j25_rig_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rig_state(table(spark, sf_dir, "lineitem"), 2, "l_suppkey", "l_partkey", "l_linenumber")


# ---- readers and writers

@query("""SELECT o_orderkey, (1700000000 + o_orderkey) * 1000000000 + o_custkey AS t_ns, 1700000000::BIGINT * 1000000000 + o_orderkey * 1000 AS t2_ns FROM orders""")
def src2_src4_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.functions.keys import stamp_ns

    micros = F.lpad((c("o_orderkey") % 1_000_000).cast("string"), 6, "0")
    seconds = F.concat((1_700_000_000 + F.floor(c("o_orderkey") / 1_000_000)).cast("string"), F.lit("."), micros)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat((1_700_000_000 + c("o_orderkey")).cast("string"), F.lit("-"), c("o_custkey").cast("string")).alias("stamp"), seconds.alias("seconds"))
    return rows.select("o_orderkey", stamp_ns(c("stamp")).alias("t_ns"), readers.seconds_ns(c("seconds")).alias("t2_ns"))


@query(f"""WITH {STREAM_SQL},
r AS (SELECT min(t_ns) AS t0 FROM stream)
SELECT row_id, t_ns AS log_ns FROM stream, r WHERE kind = 'click' AND segment_id % 3 = 0 AND t_ns BETWEEN 1704100000000000000 AND 1705000000000000000""")
def src10_log_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = stream(spark, sf_dir).select("row_id", (c("segment_id") % 3).alias("chunk_id"), c("kind").alias("topic"), c("t_ns").alias("log_ns"))
    chunks = spark.createDataFrame([(0, 0, 2**62, ["click", "view"]), (1, 0, 2**62, ["view"]), (2, 0, 1_700_000_000_000_000_000, ["click"])], "chunk_id long, start_log_ns long, stop_log_ns long, topics array<string>")
    return readers.log_window(messages, chunks, "click", 1_704_200_000_000_000_000, 1_704_900_000_000_000_000, 100_000_000_000_000).select("row_id", "log_ns")


@query("""SELECT DISTINCT least('p' || l_partkey, 'p' || l_suppkey) || ' ' || greatest('p' || l_partkey, 'p' || l_suppkey) AS line FROM lineitem WHERE l_partkey <> l_suppkey""")
def snk4_pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("p"), "l_suppkey").alias("b"))
    return readers.pair_lines(rows, "a", "b")


@query(f"WITH {TRACK_SQL}, {_WINDOWS} SELECT segment_id, frame, count(*) AS windows FROM p GROUP BY 1, 2")
def s1_window_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).groupBy("segment_id", "frame").agg(F.count("*").alias("windows"))


@query("SELECT l_partkey FROM lineitem WHERE l_quantity < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def s2_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.where("l_quantity < 10").select("l_partkey").intersect(rows.where("l_discount > 0.08").select("l_partkey"))


@query(f"""WITH {STREAM_SQL},
w AS (SELECT CAST(floor(t_ns / 3600000000000.0) AS BIGINT) AS hour, kind AS quality FROM stream)
SELECT hour, quality, count(*) AS n FROM w GROUP BY 1, 2""")
def r7_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.streaming.pairing import quality_counts

    rows = stream(spark, sf_dir).select(F.timestamp_micros((c("t_ns") / 1000).cast("long")).alias("event_time"), c("kind").alias("quality"))
    return quality_counts(rows).select((F.unix_seconds("start") / 3600).cast("long").alias("hour"), "quality", "n")


@query("""WITH a AS (SELECT l_returnflag AS arm, 'disc' AS name, avg(l_discount) AS value FROM lineitem GROUP BY 1)
SELECT arm, name, round(value, 8) AS before, round(value * 0.9, 8) AS after, value * 0.9 <= 0.046 AND value > 0.046 AS repaired FROM a WHERE value > 0.046""")
def a47_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("arm")).agg(F.avg("l_discount").alias("v"))
    source, candidate = (checks.checks(m.withColumn("v", c("v") * f), ["arm"], {"disc": (c("v"), None, 0.046)}) for f in (1.0, 0.9))
    out = tables.repaired(source, candidate, "arm")
    return out.select("arm", "name", F.round("before", 8).alias("before"), F.round("after", 8).alias("after"), "repaired")


@query(f"""WITH {STREAM_SQL} SELECT segment_id, row_id, kind
  FROM stream
  WHERE kind IN ('click', 'view')
  QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY t_ns, row_id) <= 5""")
def t1_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("segment_id").orderBy("t_ns", "row_id")
    return stream(spark, sf_dir, "click", "view").withColumn("_k", F.row_number().over(w)).where("_k <= 5").select("segment_id", "row_id", "kind")


@query(f"""WITH {STREAM_SQL}, r AS (SELECT * FROM stream WHERE kind = 'purchase'), s AS (SELECT * FROM stream WHERE kind = 'signup')
SELECT r.segment_id, r.row_id, r.t_ns, s.row_id AS sample_index, s.t_ns AS sample_t_ns, s.t_ns - r.t_ns AS residual_ns
FROM r LEFT JOIN s ON r.segment_id = s.segment_id AND abs(s.t_ns - r.t_ns) <= {TOL} QUALIFY row_number() OVER (PARTITION BY r.row_id ORDER BY abs(s.t_ns - r.t_ns), s.t_ns, s.row_id) = 1""")
def r6_streamed_nearest_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streamed nearest record: ties go to the earlier one."""
    return association.nearest(stream(spark, sf_dir, "purchase"), stream(spark, sf_dir, "signup"), TOL)
