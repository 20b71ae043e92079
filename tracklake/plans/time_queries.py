"""Associations, quality and series over the events' streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.functions import geodesy
from tracklake.operators import association as a
from tracklake.operators import quality as q
from tracklake.operators import series as s
from tracklake.plans.registry import query
from tracklake.plans.walk_sql import decimated_sql, pairs_sql
from tracklake.sources.bindings import STREAM_SQL, TRACK_SQL, stream, table, track

TOL = 6 * 3600 * 1_000_000_000
_BEST = f"""SELECT r.segment_id, r.row_id, r.t_ns, s.row_id AS sample_index, s.t_ns AS sample_t_ns, s.t_ns - r.t_ns AS residual_ns
FROM (SELECT * FROM stream WHERE kind = 'click') r LEFT JOIN (SELECT * FROM stream WHERE kind = 'view') s ON r.segment_id = s.segment_id {{on}}
QUALIFY row_number() OVER (PARTITION BY r.row_id ORDER BY abs(s.t_ns - r.t_ns), s.t_ns, s.row_id) = 1"""
NEAREST = _BEST.format(on=f"AND abs(s.t_ns - r.t_ns) <= {TOL}")
ANY = _BEST.format(on="")


def _by_frame() -> WindowSpec:
    return Window.partitionBy("segment_id").orderBy("frame")


def _click_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return stream(spark, sf_dir, "click"), stream(spark, sf_dir, "view")


@query(f"WITH {STREAM_SQL} {NEAREST}")
def j1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.nearest(*_click_view(spark, sf_dir), TOL)


VALID = f"SELECT *, coalesce(abs(residual_ns) <= {TOL}, false) AS association_valid FROM ({ANY})"


@query(f"WITH {STREAM_SQL} {VALID}")
def j2_nearest_with_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.nearest_with_validity(*_click_view(spark, sf_dir), TOL)


@query(f"""WITH {STREAM_SQL},
m AS ({NEAREST})
SELECT segment_id, arg_min(row_id, t_ns) AS row_id, min(t_ns) AS t_ns, count(*) AS n_unmatched FROM m WHERE sample_index IS NULL GROUP BY 1""")
def j3_first_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.first_unmatched(*_click_view(spark, sf_dir), TOL)


@query(f"""WITH RECURSIVE {STREAM_SQL},
u AS (SELECT segment_id, CAST(kind = 'view' AS INTEGER) AS side, t_ns AS t, row_id AS i
  FROM stream
  WHERE kind IN ('click', 'view')), {pairs_sql('u', TOL)} SELECT segment_id, i AS row_id, t AS t_ns, sample_index, residual_ns
  FROM met""")
def j4_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.one_to_one(*_click_view(spark, sf_dir), TOL)


@query(f"""WITH {STREAM_SQL},
m AS ({NEAREST})
SELECT *, CASE WHEN sample_index IS NULL THEN 'none' WHEN row_number() OVER (PARTITION BY segment_id, sample_index ORDER BY abs(residual_ns), row_id) = 1 THEN 'won' ELSE 'lost' END AS state
  FROM m""")
def j5_unique_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.unique_nearest(*_click_view(spark, sf_dir), TOL)


BRACKET = """b AS (SELECT r.segment_id, r.row_id, r.t_ns, max(s.t_ns) FILTER (s.t_ns <= r.t_ns) AS lo, min(s.t_ns) FILTER (s.t_ns >= r.t_ns) AS hi
FROM (SELECT * FROM stream WHERE kind = 'click') r LEFT JOIN (SELECT * FROM stream WHERE kind = 'view') s ON r.segment_id = s.segment_id GROUP BY ALL),
br AS (SELECT b.segment_id, b.row_id, b.t_ns, l.row_id AS lower_index, u.row_id AS upper_index, l.t_ns AS lower_t_ns, u.t_ns AS upper_t_ns,
CASE WHEN u.t_ns > l.t_ns THEN (b.t_ns - l.t_ns) / (u.t_ns - l.t_ns) WHEN u.t_ns = l.t_ns THEN 0.0 END AS alpha, l.x AS lx, u.x AS ux
FROM b LEFT JOIN stream l ON l.segment_id = b.segment_id AND l.t_ns = b.lo AND l.kind = 'view' AND b.hi IS NOT NULL LEFT JOIN stream u ON u.segment_id = b.segment_id AND u.t_ns = b.hi AND u.kind = 'view' AND b.lo IS NOT NULL)"""


@query(f"""WITH {STREAM_SQL}, {BRACKET} SELECT segment_id, row_id, t_ns, lower_index, upper_index, lower_t_ns, upper_t_ns, round(alpha, 9) AS alpha, round(lx + alpha * (ux - lx), 6) AS x
  FROM br""")
def j6_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.interpolated(*_click_view(spark, sf_dir), ["x"])
    return out.select("segment_id", "row_id", "t_ns", "lower_index", "upper_index", "lower_t_ns", "upper_t_ns", F.round("alpha", 9).alias("alpha"), F.round("x", 6).alias("x"))


@query(f"""WITH {STREAM_SQL}, v AS (SELECT * FROM stream WHERE kind = 'view'), c AS (SELECT *, t_ns - {TOL} AS a, t_ns + {TOL} AS z FROM stream WHERE kind = 'click'),
e AS (SELECT c.segment_id, c.row_id, max(v.t_ns) FILTER (v.t_ns <= a) AS lo, min(v.t_ns) FILTER (v.t_ns >= a) AS lo2, max(v.t_ns) FILTER (v.t_ns <= z) AS hi2, min(v.t_ns) FILTER (v.t_ns >= z) AS hi FROM c LEFT JOIN v USING (segment_id) GROUP BY ALL)
SELECT e.segment_id, e.row_id, lo IS NOT NULL AND lo2 IS NOT NULL AND hi2 IS NOT NULL AND hi IS NOT NULL AND count(*) FILTER (v.t_ns >= lo AND v.t_ns <= hi AND v.k < 10) = 0 AS supported FROM e LEFT JOIN v USING (segment_id) GROUP BY e.segment_id, e.row_id, lo, lo2, hi2, hi""")
def j9_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.supported(*_click_view(spark, sf_dir), F.col("k") >= 10, TOL, TOL)


@query(f"""WITH {STREAM_SQL},
c AS (SELECT *, CAST(round_even(t_ns / 1e9 * 0.001, 0) AS BIGINT) AS tick FROM stream)
SELECT l.segment_id, l.tick, l.row_id AS left_index, r.row_id AS right_index
  FROM c l JOIN c r ON l.segment_id = r.segment_id AND l.tick = r.tick
  WHERE l.kind = 'click' AND r.kind = 'view'""")
def j27_time_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.time_key_pairs(*_click_view(spark, sf_dir), 0.001)


@query(f"""WITH {STREAM_SQL},
m AS ({NEAREST})
SELECT segment_id, count(residual_ns) AS n, quantile_cont(abs(residual_ns), 0.5) AS median_abs, max(abs(residual_ns)) AS max_abs, round(avg(residual_ns), 3) AS mean
  FROM m
  GROUP BY 1""")
def a1_residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.residual_summary(a.nearest(*_click_view(spark, sf_dir), TOL), "residual_ns", "segment_id").withColumn("mean", F.round("mean", 3))


RUNS = "SELECT segment_id, association_valid, arg_min(row_id, t_ns) AS first_index, arg_max(row_id, t_ns) AS last_index, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY t_ns) - row_number() OVER (PARTITION BY segment_id, association_valid ORDER BY t_ns) AS g FROM m) GROUP BY segment_id, association_valid, g"


@query(f"WITH {STREAM_SQL}, m AS ({VALID}) {RUNS}")
def w13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.runs(a.nearest_with_validity(*_click_view(spark, sf_dir), TOL), "association_valid", "segment_id", "t_ns", "row_id")


@query(f"""WITH {STREAM_SQL}, m AS ({VALID}), r AS ({RUNS}), l AS (SELECT segment_id, max(n) AS longest_run FROM r WHERE NOT association_valid GROUP BY 1),
o AS (SELECT segment_id, count(*) AS n, CAST(sum(CAST(NOT association_valid AS BIGINT)) AS BIGINT) AS n_invalid, max(abs(residual_ns)) FILTER (association_valid) AS max_valid_residual_ns FROM m GROUP BY 1)
SELECT segment_id, n, n_invalid, max_valid_residual_ns, coalesce(longest_run, 0) AS longest_run, n_invalid / n AS share, n_invalid / n <= 0.5 AND coalesce(longest_run, 0) <= 4 AS passed FROM o LEFT JOIN l USING (segment_id)""")
def q3_dropout_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.dropout_budget(a.nearest_with_validity(*_click_view(spark, sf_dir), TOL), 0.5, 4)


QUALITY = "CASE WHEN NOT (status >= 0) THEN 'invalid' WHEN carrier >= 2 THEN 'rtk_fixed' WHEN carrier = 1 THEN 'rtk_float' WHEN status >= 1 THEN 'differential' ELSE 'standalone' END"


def _quality() -> F.Column:
    return q.position_quality(F.col("status"), F.col("carrier"), F.col("x").isNotNull())


@query(f"WITH {TRACK_SQL} SELECT segment_id, frame, status >= 0 AS valid, {QUALITY} AS quality FROM track")
def p1_position_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).select("segment_id", "frame", q.position_valid(F.col("status"), F.col("x").isNotNull()).alias("valid"), _quality().alias("quality"))


@query(f"WITH {TRACK_SQL} SELECT segment_id, frame, CASE WHEN status >= 0 THEN 'unknown_valid' ELSE 'invalid' END AS quality FROM track")
def p2_offline_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).select("segment_id", "frame", q.offline_quality(F.col("status"), F.col("x").isNotNull()).alias("quality"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN ' rtk-fixed ' WHEN 1 THEN 'Float RTK' WHEN 2 THEN 'spp' WHEN 3 THEN 'Differential  GNSS' WHEN 4 THEN 'x/' || l_returnflag WHEN 5 THEN 'sbas' ELSE '__unknown__' END AS name
  FROM lineitem)
SELECT l_orderkey, l_linenumber, name, CASE l_linenumber % 7 WHEN 0 THEN 'FIXED_RTK' WHEN 1 THEN 'FLOAT_RTK' WHEN 2 THEN 'SPP' WHEN 3 THEN 'DGNSS' WHEN 4 THEN 'UNRECOGNIZED:X_' || right(name, 1) WHEN 5 THEN 'SBAS' ELSE 'UNKNOWN' END AS mode
  FROM n""")
def p3_receiver_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (" rtk-fixed ", "Float RTK", "spp", "Differential  GNSS", "", "sbas", "__unknown__")])
    at = F.col("l_linenumber") % 7
    name = F.when(at == 4, F.concat(F.lit("x/"), "l_returnflag")).otherwise(F.element_at(names, at + 1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name")).withColumn("mode", q.receiver_mode(F.col("name")))


P4 = "CASE k % 6 WHEN 0 THEN 'SPP' WHEN 1 THEN 'DGNSS' WHEN 2 THEN 'FLOAT_RTK' WHEN 3 THEN 'FIXED_RTK' WHEN 4 THEN 'SBAS' ELSE 'UNKNOWN' END"


@query(f"""WITH {STREAM_SQL}, m AS (SELECT *, {P4} AS mode, k % 11 = 0 AS err, k % 4 - 1 AS status, k % 5 > 0 AS matched FROM stream),
c AS (SELECT *, CASE WHEN err THEN -1 WHEN mode IN ('SPP', 'DGNSS', 'SBAS') THEN 0 WHEN mode = 'FLOAT_RTK' THEN 1 WHEN mode = 'FIXED_RTK' THEN 2 ELSE -1 END AS carrier FROM m)
SELECT segment_id, row_id, carrier, CASE WHEN matched THEN NOT err AND status >= 0 AND mode <> 'UNKNOWN' ELSE status >= 0 END AS valid,
CASE WHEN matched THEN CASE WHEN err OR status < 0 OR mode = 'UNKNOWN' THEN 'invalid' WHEN mode = 'SPP' THEN 'standalone' WHEN mode IN ('DGNSS', 'SBAS') THEN 'differential' WHEN mode = 'FLOAT_RTK' THEN 'rtk_float' ELSE 'rtk_fixed' END ELSE {QUALITY} END AS quality FROM c""")
def p4_receiver_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    modes = F.array(*[F.lit(x) for x in ("SPP", "DGNSS", "FLOAT_RTK", "FIXED_RTK", "SBAS", "UNKNOWN")])
    rows = stream(spark, sf_dir).withColumn("mode", F.element_at(modes, (k % 6 + 1).cast("int")))
    state = q.receiver_state(F.col("mode"), F.when(k % 11 == 0, 1).otherwise(0), k % 4 - 1, F.col("x").isNotNull(), k % 5 > 0)
    return rows.select("segment_id", "row_id", *[c.alias(n) for n, c in state.items()])


@query(f"WITH {STREAM_SQL} SELECT segment_id, row_id, k & 1 > 0 AND k & 2 > 0 AND k & 4 > 0 AND k & 8 = 0 AND k % 3 >= 2 AND x >= 1 AS valid FROM stream")
def p5_heading_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda n: F.col("k").bitwiseAND(n) > 0
    flags = F.array(bit(1), bit(2), bit(4), F.lit(True), bit(8), F.lit(False), F.lit(True), F.lit(False))
    return stream(spark, sf_dir).select("segment_id", "row_id", q.heading_valid(flags, F.col("k") % 3, F.col("x").isNotNull(), F.col("x") - 1).alias("valid"))


@query(f"""WITH {STREAM_SQL} SELECT segment_id, row_id, round(-k * 0.01::DOUBLE, 9) AS east, round(k * 0.01::DOUBLE + (k % 7) * 1e-4, 9) AS north, round(-(2 * k * 0.01::DOUBLE + 1e-4), 9) AS up
  FROM stream""")
def p6_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.functions.geodesy import ned_to_enu

    k = F.col("k")
    e, n, u = ned_to_enu(q.fixed_point_m(k, k % 7), q.fixed_point_m(-k, F.lit(0)), q.fixed_point_m(2 * k, F.lit(1)))
    return stream(spark, sf_dir).select("segment_id", "row_id", F.round(e, 9).alias("east"), F.round(n, 9).alias("north"), F.round(u, 9).alias("up"))


@query(f"""WITH {TRACK_SQL} SELECT segment_id, frame, concat_ws(',', CASE WHEN x < 0.3 THEN 'blur' END, CASE WHEN y < 0.2 THEN 'exposure' END, CASE WHEN abs(x - y) > 0.8 THEN 'stereo_sync' END, CASE WHEN var > 0.008 THEN 'rtk_covariance' END, CASE WHEN status NOT IN (1, 2) THEN 'rtk_status' END) AS issues, x >= 0.3 AND y >= 0.2 AND abs(x - y) <= 0.8 AND var <= 0.008 AND status IN (1, 2) AS acceptable
  FROM track""")
def p8_frame_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    issues = q.frame_issues(q.FramePolicy(0.3, 0.2, 0.8, 0.008, (1, 2)), c("x"), c("y"), c("x") - c("y"), c("var"), c("status"))
    return track(spark, sf_dir).select("segment_id", "frame", F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("acceptable"))


@query(f"""WITH {TRACK_SQL},
p AS (SELECT *, CASE WHEN status < 0 THEN 'position_invalid' WHEN carrier < 1 THEN 'no_carrier_solution' WHEN var > 0.006 THEN 'too_uncertain' WHEN x < 0.2 THEN 'outside' END AS reason
  FROM track)
SELECT coalesce(reason, 'used') AS reason, count(*) AS n FROM p GROUP BY 1""")
def p11_prior_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    reason = q.first_reason(("position_invalid", c("status") < 0), ("no_carrier_solution", c("carrier") < 1), ("too_uncertain", c("var") > 0.006), ("outside", c("x") < 0.2))
    return track(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {TRACK_SQL} SELECT segment_id, frame, round(var / CASE {QUALITY} WHEN 'rtk_fixed' THEN 1.0 WHEN 'rtk_float' THEN 0.5 WHEN 'differential' THEN 0.2 WHEN 'standalone' THEN 0.1 ELSE 0.05 END, 9) AS variance
  FROM track""")
def p12_weighted_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).select("segment_id", "frame", F.round(q.weighted_variance(F.col("var"), _quality()), 9).alias("variance"))


@query(f"""WITH {TRACK_SQL},
w AS (SELECT *, min(t_ns) OVER (PARTITION BY segment_id) AS t0 FROM track)
SELECT segment_id, frame, (t_ns - t0) / 1e9 AS since_s FROM w WHERE t_ns - t0 BETWEEN 100000::BIGINT * 1000000000 AND 400000::BIGINT * 1000000000""")
def p14_relative_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    first = rows.groupBy("segment_id").agg(F.min("t_ns").alias("t0"))
    since = F.col("t_ns") - F.col("t0")
    return rows.join(first, "segment_id").where(since.between(100_000 * 10**9, 400_000 * 10**9)).select("segment_id", "frame", (since / 1e9).alias("since_s"))


@query(f"WITH {TRACK_SQL} SELECT segment_id, frame FROM track WHERE frame % 7 = 0")
def p16_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.every_kth(track(spark, sf_dir), _by_frame(), 7).select("segment_id", "frame")


@query(f"""WITH {TRACK_SQL} SELECT segment_id, count(*) FILTER (x >= 0.1) AS kept, count(*) FILTER (x < 0.1) AS dropped, coalesce(string_agg(frame, ',' ORDER BY frame) FILTER (x < 0.1), '') AS frames
  FROM track
  GROUP BY 1""")
def p17_required_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("x") < 0.1
    return track(spark, sf_dir).groupBy("segment_id").agg(F.count_if(~low).alias("kept"), F.count_if(low).alias("dropped"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(low, F.col("frame")))), lambda x: x.cast("string")), ",").alias("frames"))


@query(f"WITH {TRACK_SQL} SELECT {QUALITY} AS quality, count(*) AS n FROM track GROUP BY 1")
def a2_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).groupBy(_quality().alias("quality")).agg(F.count("*").alias("n"))


@query(f"""WITH {STREAM_SQL} SELECT segment_id, count(x) AS n, min(x) AS min, quantile_cont(x, 0.5) AS median, round(quantile_cont(x, 0.95), 6) AS p95, max(x) AS max, round(avg(x), 6) AS mean
  FROM stream
  GROUP BY 1""")
def a3_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = q.distribution(stream(spark, sf_dir), "x", "segment_id")
    return out.withColumn("p95", F.round("p95", 6)).withColumn("mean", F.round("mean", 6))


STEP = "coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0)"


@query(f"""WITH {TRACK_SQL},
d AS (SELECT *, {STEP} AS step FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY frame)),
l AS (SELECT *, sum(step) OVER (PARTITION BY segment_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS path_m FROM d),
c AS (SELECT *, lag(floor((path_m + 1e-12) / 1.5)) OVER (PARTITION BY segment_id ORDER BY frame) AS before FROM l)
SELECT segment_id, frame, round(path_m, 6) AS path_m FROM c WHERE before IS NULL OR floor((path_m + 1e-12) / 1.5) > before""")
def w2_sample_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sample_by_distance(track(spark, sf_dir), 1.5, _by_frame(), "x", "y").select("segment_id", "frame", F.round("path_m", 6).alias("path_m"))


@query(f"""WITH {TRACK_SQL},
d AS (SELECT *, {STEP} AS step, (t_ns - lag(t_ns) OVER w) / 1e9 AS dt_s FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY frame)),
v AS (SELECT *, step / dt_s AS speed FROM d)
SELECT segment_id, frame, round(dt_s, 6) AS dt_s, round(speed * 1e6, 4) AS speed, round((speed - lag(speed) OVER (PARTITION BY segment_id ORDER BY frame)) / dt_s * 1e9, 3) AS acceleration
  FROM v""")
def w3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.rates(track(spark, sf_dir), _by_frame(), "t_ns", "x", "y")
    return out.select("segment_id", "frame", F.round("dt_s", 6).alias("dt_s"), F.round(F.col("speed") * 1e6, 4).alias("speed"), F.round(F.col("acceleration") * 1e9, 3).alias("acceleration"))


@query(f"""WITH {TRACK_SQL} SELECT segment_id, frame, coalesce(status <> lead(status) OVER w, false) AS before_change, coalesce(status <> lag(status) OVER w, false) AS at_change
  FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY frame)""")
def w4_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.state_changes(track(spark, sf_dir), _by_frame(), "status").select("segment_id", "frame", "before_change", "at_change")


@query(f"""WITH {TRACK_SQL},
b AS (SELECT segment_id, frame, frame * 8 // count(*) OVER (PARTITION BY segment_id) AS block FROM track)
SELECT *, CASE WHEN block % 2 = 1 THEN 'holdout' ELSE 'calibration' END AS role FROM b""")
def w6_temporal_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.temporal_role(track(spark, sf_dir), _by_frame(), "segment_id", 8).select("segment_id", "frame", "block", "role")


@query(f"""WITH {TRACK_SQL},
b AS (SELECT segment_id, frame, CASE WHEN max(t_ns) OVER w > min(t_ns) OVER w THEN least(CAST(floor((t_ns - min(t_ns) OVER w) * 10 / (max(t_ns) OVER w - min(t_ns) OVER w)) AS BIGINT), 9) ELSE 0 END AS block
  FROM track WINDOW w AS (PARTITION BY segment_id))
SELECT *, block % 3 = 1 AS holdout FROM b""")
def w7_time_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.time_blocks(track(spark, sf_dir), "segment_id", "t_ns", 10, 3, 1).select("segment_id", "frame", "block", "holdout")


@query(f"""WITH {TRACK_SQL},
o AS (SELECT t.segment_id, t.frame, unnest(range(-2, 3)) AS d, count(*) OVER (PARTITION BY t.segment_id) AS n FROM track t)
SELECT o.segment_id, o.frame, round(avg(s.x), 6) AS x_smooth
  FROM (SELECT segment_id, frame, d, n
  FROM o) o JOIN track s ON s.segment_id = o.segment_id AND s.frame = least(greatest(o.frame + d, 0), (SELECT max(frame)
  FROM track z
  WHERE z.segment_id = o.segment_id))
  GROUP BY 1, 2""")
def w8_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.smoothed(track(spark, sf_dir), _by_frame(), "segment_id", 5, "x").select("segment_id", "frame", F.round("x_smooth", 6).alias("x_smooth"))


@query(f"""WITH {TRACK_SQL},
h AS (SELECT segment_id, frame, (t_ns - lag(t_ns) OVER w) / 1e9 AS h0, (lead(t_ns) OVER w - t_ns) / 1e9 AS h1, x - lag(x) OVER w AS d0, lead(x) OVER w - x AS d1
  FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY frame))
SELECT segment_id, frame, round(1e6 * CASE WHEN h0 IS NULL THEN d1 / h1 WHEN h1 IS NULL THEN d0 / h0 ELSE (h1 * d0 / h0 + h0 * d1 / h1) / (h0 + h1) END, 4) AS dx FROM h""")
def w9_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("s", (F.col("t_ns") - F.lit(1_700_000_000_000_000_000)) / 1e9)
    return rows.select("segment_id", "frame", F.round(1e6 * s.gradient(_by_frame(), "x", "s"), 4).alias("dx"))


ANGLE = "atan2(y - 0.5, x - 0.5)"


@query(f"""WITH {TRACK_SQL},
g AS (SELECT segment_id, frame, {ANGLE} AS a, {ANGLE} - lag({ANGLE}) OVER (PARTITION BY segment_id ORDER BY frame) AS d FROM track)
SELECT segment_id, frame, round(a + sum(CASE WHEN d > pi() THEN -2 * pi() WHEN d < -pi() THEN 2 * pi() ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS angle
  FROM g""")
def w10_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("a", geodesy.atan2_c(F.col("y") - 0.5, F.col("x") - 0.5))
    return s.unwrapped(rows, _by_frame(), "a", "angle").select("segment_id", "frame", F.round("angle", 6).alias("angle"))


@query(f"""WITH {TRACK_SQL}, v AS (SELECT segment_id, frame, CASE WHEN carrier > 0 THEN x END AS v, CASE WHEN carrier > 0 THEN frame END AS i FROM track),
n AS (SELECT *, max(i) OVER (PARTITION BY segment_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS lo, min(i) OVER (PARTITION BY segment_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM v)
SELECT n.segment_id, n.frame, round(CASE WHEN n.v IS NOT NULL THEN n.v WHEN lo IS NULL THEN b.v WHEN hi IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (n.frame - lo) / (hi - lo) END, 6) AS filled FROM n LEFT JOIN v a ON a.segment_id = n.segment_id AND a.frame = lo LEFT JOIN v b ON b.segment_id = n.segment_id AND b.frame = hi""")
def w12_gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("v", F.when(F.col("carrier") > 0, F.col("x")))
    return s.gaps_filled(rows, _by_frame(), "v", "filled").select("segment_id", "frame", F.round("filled", 6).alias("filled"))


@query(f"""WITH {TRACK_SQL},
d AS (SELECT *, {STEP} AS p, coalesce(abs(x - lag(x) OVER w), 0) AS r FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY frame)),
l AS (SELECT segment_id, frame, sum(p) OVER v AS p, sum(r) OVER v AS r FROM d WINDOW v AS (PARTITION BY segment_id ORDER BY frame ROWS 9 PRECEDING))
SELECT segment_id, frame, round(p, 6) AS prior_m, round(r, 6) AS refined_m, abs(r - p) > greatest(0.5, 0.3 * p) AS failed FROM l WHERE frame >= 10""")
def w17_path_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.path_windows(track(spark, sf_dir), _by_frame(), 10, ("x", "y"), ("x",), 0.5, 0.3)
    return out.select("segment_id", "frame", F.round("prior_m", 6).alias("prior_m"), F.round("refined_m", 6).alias("refined_m"), "failed")


@query(f"""WITH {TRACK_SQL},
n AS (SELECT segment_id, count(*) AS n FROM track GROUP BY 1),
w AS (SELECT segment_id, n, unnest(range(0, CASE WHEN n <= 20 THEN 1 ELSE CAST(ceil((n - 20) / 15.0) AS BIGINT) + 1 END)) AS ordinal FROM n)
SELECT segment_id, ordinal, greatest(0, least(ordinal * 15 + 20, n) - 20) AS first_row, least(ordinal * 15 + 20, n) - 1 AS last_row FROM w""")
def w20_row_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.row_windows(track(spark, sf_dir), "segment_id", 20, 5)


@query(f"WITH {TRACK_SQL} SELECT segment_id, frame, least(frame + 1, count(*) OVER (PARTITION BY segment_id) - frame) AS weight FROM track")
def w21_end_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).select("segment_id", "frame", s.end_distance(_by_frame(), "segment_id").alias("weight"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) * 1000 AS start_ns, epoch_us(o_orderdate) * 1000 + (o_orderkey % 50) * 86400000000000 AS stop_ns
  FROM orders)
SELECT o_custkey, o_orderkey, start_ns - lag(stop_ns) OVER w AS gap, coalesce(start_ns > lag(start_ns) OVER w, true) AS start_increases
  FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def w22_chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.sources.bindings import nanoseconds

    start = nanoseconds("o_orderdate")
    chunks = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", start.alias("start_ns"), (start + F.col("o_orderkey") % 50 * 86_400_000_000_000).alias("stop_ns"))
    return s.chain_gaps(chunks, "o_custkey", "start_ns", "stop_ns", "o_orderkey").select("o_custkey", "o_orderkey", "gap", "start_increases")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) * 1000 AS t_ns FROM orders),
b AS (SELECT *, lag(t_ns) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM c)
SELECT * FROM b WHERE t_ns <= before""")
def w23_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.sources.bindings import nanoseconds

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", nanoseconds("o_orderdate").alias("t_ns"))
    return s.order_violations(rows, "o_custkey", "o_orderkey", "t_ns")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) = 1""")
def w24_first_per_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber"))
    return s.first_per_time(rows, "l_suppkey", "l_shipdate", "at").select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH RECURSIVE {STREAM_SQL},
u AS (SELECT segment_id, t_ns AS t, row_id AS i FROM stream), {decimated_sql('u', 86_400 * 10**9)} SELECT segment_id, i AS row_id, t AS t_ns FROM walk""")
def w25_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.decimated(stream(spark, sf_dir), 86_400 * 10**9, "segment_id", "t_ns", "row_id")


@query(f"""WITH {TRACK_SQL},
m AS (SELECT segment_id, frame, status >= 1 AS known, carrier = 2 AS member, CASE WHEN status >= 1 THEN frame END AS i FROM track),
n AS (SELECT *, max(i) OVER (PARTITION BY segment_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS lo, min(i) OVER (PARTITION BY segment_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi
  FROM m)
SELECT n.segment_id, n.frame, CASE WHEN n.known THEN n.member ELSE coalesce(a.member, false) OR coalesce(b.member, false) END AS inside
  FROM n
  LEFT JOIN m a ON a.segment_id = n.segment_id AND a.frame = lo
  LEFT JOIN m b ON b.segment_id = n.segment_id AND b.frame = hi""")
def w29_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("member", F.col("carrier") == 2)
    return s.inherited(rows, _by_frame(), "member", F.col("status") >= 1, "inside").select("segment_id", "frame", "inside")
