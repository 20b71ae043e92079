"""Matches, rays, images and support over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.keys import PAIR_BASE
from tracklake.operators import checks, cloud, images, matching, scans
from tracklake.plans.registry import query
from tracklake.plans.space_queries import _COV, TILES_SQL, _covariance, _tiles, rounded
from tracklake.plans.time_queries import QUALITY, _quality
from tracklake.sources.bindings import POINTS_SQL, STREAM_SQL, TRACK_SQL, points, stream, table, track

c = F.col


@query(f"WITH {TRACK_SQL} SELECT segment_id, frame, CASE WHEN status >= 0 AND {QUALITY} <> 'invalid' THEN round(sqrt(var), 6) END AS std FROM track")
def p9_trusted_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    std = matching.trusted_std(c("status") >= 0, _quality(), (c("var"), zero, zero, c("var"), zero, c("var")))
    return track(spark, sf_dir).select("segment_id", "frame", F.round(std, 6).alias("std"))


@query(f"""WITH {TRACK_SQL},
s AS (SELECT *, CASE WHEN segment_id % 2 = 0 THEN 0.01 ELSE var END AS v FROM track)
SELECT segment_id, frame, segment_id % 2 = 0 OR bool_and(abs(v - 0.01) <= 1e-9) OVER (PARTITION BY segment_id) AS overridden, CASE WHEN segment_id % 2 = 0 OR bool_and(abs(v - 0.01) <= 1e-9) OVER (PARTITION BY segment_id) THEN 0.5::DOUBLE ELSE v END AS variance
  FROM s""")
def p13_static_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("v", F.when(c("segment_id") % 2 == 0, 0.01).otherwise(c("var")))
    return matching.static_override(rows, "v", 0.01, 0.5, 1e-9, "segment_id").select("segment_id", "frame", "overridden", c("variance_effective").alias("variance"))


@query(f"""WITH {STREAM_SQL} SELECT segment_id, greatest(min(t_ns) FILTER (kind = 'click') - 5, min(t_ns)) AS start_ns, least(max(t_ns) FILTER (kind = 'click') + 5, max(t_ns)) AS stop_ns
  FROM stream
  GROUP BY 1""")
def p15_clamped_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.when(c("kind") == "click", c("t_ns"))
    start, stop = matching.clamped_window(F.min(click), F.max(click), 5, F.min("t_ns"), F.max("t_ns"))
    return stream(spark, sf_dir).groupBy("segment_id").agg(start.alias("start_ns"), stop.alias("stop_ns"))


@query(f"""WITH {POINTS_SQL} SELECT id, CASE WHEN abs(x - u) <= 0.5 THEN 'accept' WHEN id % 3 > 0 OR abs(x - u) <= 0.5 THEN 'replace' ELSE 'fail' END AS decision
  FROM points
  WHERE id % 3 > 0
  UNION ALL SELECT id, 'fail'
  FROM points
  WHERE id % 3 = 0""")
def p23_resolved_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = F.when(c("id") % 3 > 0, c("u"))
    return points(spark, sf_dir).select("id", matching.resolved_covariance(c("x"), derived, 0.5).alias("decision"))


@query(f"""WITH {POINTS_SQL} SELECT id, round((abs(u) / 5 - 0.5) / 0.28209479177387814, 6) AS red, round(ln(0.02), 6) AS log_scale, round(ln(0.1 / 0.9), 6) AS opacity_logit
  FROM points""")
def p24_initial_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.functions.keys import logit

    return points(spark, sf_dir).select("id", *rounded(red=cloud.initial_color(F.abs("u") / 5), log_scale=F.log(F.lit(0.02)), opacity_logit=logit(F.lit(0.1))))


@query(f"""WITH {TRACK_SQL},
k AS (SELECT * FROM track WHERE frame % 5 = 0)
SELECT o.segment_id, o.frame, k.frame AS keyframe, CAST(row_number() OVER (PARTITION BY o.segment_id, o.frame ORDER BY abs(o.t_ns - k.t_ns), k.frame) AS INTEGER) AS rank
  FROM track o JOIN k ON o.segment_id = k.segment_id AND abs(o.t_ns - k.t_ns) <= 80000000000000
  WHERE o.frame % 5 > 0
  QUALIFY rank <= 2""")
def j13_registration_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    return matching.registration_edges(rows, rows.where("frame % 5 = 0"), 2, 80_000 * 10**9)


_PAIRS = f"e AS (SELECT least(l_partkey, l_suppkey) * {PAIR_BASE} + greatest(l_partkey, l_suppkey) AS pair_id, l_quantity, l_linenumber FROM lineitem WHERE l_partkey <> l_suppkey)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey")
    return rows.select((F.least("l_partkey", "l_suppkey") * PAIR_BASE + F.greatest("l_partkey", "l_suppkey")).alias("pair_id"), "l_quantity", "l_linenumber")


@query(f"""WITH {_PAIRS},
m AS (SELECT pair_id, count(*) AS n FROM e WHERE l_quantity > 10 GROUP BY 1),
g AS (SELECT pair_id, count(*) AS n FROM e WHERE l_quantity < 40 GROUP BY 1),
b AS (SELECT pair_id, coalesce(m.n, 0) AS raw, coalesce(g.n, 0) AS verified FROM m FULL JOIN g USING (pair_id))
SELECT pair_id, (pair_id - pair_id % {PAIR_BASE}) // {PAIR_BASE} AS image_a, pair_id % {PAIR_BASE} AS image_b, a.p_size AS frame_a, z.p_size AS frame_b, raw, verified
  FROM b
  LEFT JOIN part a ON a.p_partkey = (pair_id - pair_id % {PAIR_BASE}) // {PAIR_BASE}
  LEFT JOIN part z ON z.p_partkey = pair_id % {PAIR_BASE}""")
def j22_pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scans.spread(_pairs(spark, sf_dir), "pair_id")
    m, g = (e.where(w).groupBy("pair_id").agg(F.count("*").alias("n")) for w in ("l_quantity > 10", "l_quantity < 40"))
    return matching.pair_evidence(m, g, table(spark, sf_dir, "part").select(c("p_partkey").alias("image_id"), c("p_size").alias("frame")))


_RAYS = "k AS (SELECT tile AS image_id, id AS idx, x / sqrt(x * x + y * y + 1) AS rx, y / sqrt(x * x + y * y + 1) AS ry, 1 / sqrt(x * x + y * y + 1) AS rz FROM points), m AS (SELECT a.image_id * 100 + b.image_id AS pair_id, a.rx * b.rx + a.ry * b.ry + a.rz * b.rz AS d FROM k a JOIN k b ON b.idx = a.idx + 1 AND a.image_id < b.image_id)"


@query(f"""WITH {POINTS_SQL}, {_RAYS} SELECT pair_id, count(*) AS n, round(min(degrees(acos(least(1, greatest(-1, d))))), 4) AS least, round(quantile_cont(degrees(acos(least(1, greatest(-1, d)))), 0.5), 4) AS median, round(max(degrees(acos(least(1, greatest(-1, d))))), 4) AS largest
  FROM m
  GROUP BY 1""")
def j23_a15_parallax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    keypoints = p.select(c("tile").alias("image_id"), c("id").alias("idx"), "x", "y")
    a, b = keypoints.select(c("image_id").alias("image_a"), c("idx").alias("idx1")), keypoints.select(c("image_id").alias("image_b"), c("idx").alias("idx2"))
    links = a.join(b, (c("idx2") == c("idx1") + 1) & (c("image_a") < c("image_b"))).withColumn("pair_id", c("image_a") * 100 + c("image_b"))
    cameras = keypoints.select("image_id").distinct().withColumns({"fx": F.lit(1.0), "fy": F.lit(1.0), "cx": F.lit(0.0), "cy": F.lit(0.0)})
    out = matching.parallax(matching.rays(links, keypoints, cameras))
    return out.select("pair_id", "n", *rounded(4, **{n: c(n) for n in ("least", "median", "largest")}))


@query(f"""WITH {_PAIRS},
p AS (SELECT pair_id, l_linenumber AS grp, count(*) AS n, max(l_quantity) AS q FROM e GROUP BY 1, 2)
SELECT grp, pair_id, q, n FROM p WHERE n >= 1 AND q < 45 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY q DESC, n DESC, pair_id) = 1""")
def a16_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).groupBy("pair_id", c("l_linenumber").alias("grp")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return matching.best_pair(p, (c("n") >= 1) & (c("q") < 45), ["q", "n"], "grp").select("grp", "pair_id", "q", "n")


@query("""WITH h AS (SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 3) AS n FROM part)
SELECT count(*) AS images, count(*) FILTER (n = 0) AS without, CAST(sum(n) AS BIGINT) AS features, (SELECT count(*)
  FROM supplier) AS pairs, count(*) FILTER (n = 0) > 0 OR (SELECT count(*)
  FROM supplier) = 0 AS partial
  FROM h""")
def a14_feature_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(c("p_partkey").alias("image_id"))
    features = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(c("l_partkey").alias("image_id"))
    return matching.feature_inventory(part, features, table(spark, sf_dir, "supplier"))


@query(f"""WITH {POINTS_SQL},
r AS (SELECT tile, id // 100 AS name, x, y, z, (tile % 3)::DOUBLE AS u, CASE WHEN tile = 4 THEN x ELSE 1.0 END AS v, 2.0::DOUBLE AS w FROM points)
SELECT tile, name, count(*) AS windows, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(min(v), 6) AS v, max(u) - min(u) <= 1e-6 AND max(v) - min(v) <= 1e-6 AS agree
  FROM r
  GROUP BY 1, 2""")
def a41_calibration_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumns({"name": F.floor(c("id") / 100), "u": (c("tile") % 3).cast("double"), "v": F.when(c("tile") == 4, c("x")).otherwise(1.0), "w": F.lit(2.0)})
    return matching.calibration_targets(rows, 1e-6, "tile", "name").select("tile", "name", "windows", *rounded(x=c("x"), y=c("y"), v=c("v")), "agree")


@query(f"WITH {POINTS_SQL}, {_COV} SELECT id, true AS raised, round(xx + yy + zz, 6) AS at_least FROM cov")
def g7_floored_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a floor under the smallest eigenvalue nothing changes; with one above, the least eigenvalue is the floor."""
    from tracklake.functions import symmetric

    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    rows = points(spark, sf_dir).select("id", *[v.alias(n) for n, v in zip(names, _covariance(), strict=True)])
    low = symmetric.eigenvalues(tuple(c(n) for n in names))[0]
    same = matching.floored_covariance(rows, 0.5).select("id", F.round(c("xx") + c("yy") + c("zz"), 6).alias("at_least"))
    raised = matching.floored_covariance(rows, 4.0).select("id", (low >= 4.0 - 1e-6).alias("raised"))
    return raised.join(same, "id")


@query(f"""WITH {POINTS_SQL},
s AS (SELECT DISTINCT tile, floor((x * 0.6 + y * 0.8) / 0.5) * 0.5 AS u, floor((y * 0.6 - x * 0.8) / 0.5) * 0.5 AS v FROM points)
SELECT tile, count(*) AS cells, round(sum(u), 6) AS su FROM s GROUP BY 1""")
def a18_support_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = images.support_cells(points(spark, sf_dir), (0.6, 0.8), 0.5, "tile")
    return cells.groupBy("tile").agg(F.count("*").alias("cells"), F.round(F.sum("u"), 6).alias("su"))


@query(f"""WITH {POINTS_SQL},
f AS (SELECT DISTINCT id % 90 AS frame FROM points),
s AS (SELECT DISTINCT id % 90 AS frame, floor(x / 0.5) AS u FROM points WHERE x > 1),
n AS (SELECT f.frame, count(s.frame) AS n FROM f LEFT JOIN s USING (frame) GROUP BY 1)
SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most, round(avg(CAST(n = 0 AS DOUBLE)), 9) AS depthless, avg(CAST(n = 0 AS DOUBLE)) <= 0.3 AS passed
  FROM n""")
def a19_support_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("frame", c("id") % 90)
    cells = p.where("x > 1").select("frame", F.floor(c("x") / 0.5).alias("u")).distinct()
    return images.support_diagnostics(cells, p, 0.3).withColumn("depthless", F.round("depthless", 9))


@query(f"""WITH {POINTS_SQL},
n AS (SELECT tile, count(*) AS n_source, count(*) FILTER (x > 0) AS n_target FROM points GROUP BY 1)
SELECT tile, n_source, n_target, n_target / 100 AS coverage, round(n_target / n_source, 9) AS retention, n_target / 100 >= 0.2 AND n_target / n_source >= 0.5 AS passed
  FROM n""")
def a25_projection_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return images.projection_coverage(p, p.where("x > 0"), 100, 0.2, 0.5, "tile").withColumn("retention", F.round("retention", 9))


@query(f"""WITH {POINTS_SQL},
r AS (SELECT tile, abs(x) + 1 AS m, abs(x) + 1 + u / 50 AS e FROM points)
SELECT tile, count(*) AS n, round(quantile_cont(abs(m - e), 0.5), 6) AS median_error, round(quantile_cont(abs(m - e), 0.95), 6) AS p95_error, round(quantile_cont(m / e, 0.5), 6) AS ratio, quantile_cont(m / e, 0.5) BETWEEN 0.999 AND 1.002 AS passed
  FROM r
  GROUP BY 1""")
def a26_depth_scale_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("tile", (F.abs("x") + 1).alias("measured"), (F.abs("x") + 1 + c("u") / 50).alias("expected"))
    out = images.depth_scale_audit(rows, 0.999, 1.002, "tile")
    return out.select("tile", "n", *rounded(**{n: c(n) for n in ("median_error", "p95_error", "ratio")}), "passed")


@query(f"""WITH {POINTS_SQL}, p AS (SELECT tile, CAST(floor(x * 2) AS BIGINT) AS u, CAST(floor(y * 2) AS BIGINT) AS v, max(z) AS value FROM points GROUP BY 1, 2, 3),
l AS (SELECT p.tile, a.value + b.value + d.value + e.value - 4 * p.value AS l FROM p JOIN p a ON a.tile = p.tile AND a.u = p.u + 1 AND a.v = p.v JOIN p b ON b.tile = p.tile AND b.u = p.u - 1 AND b.v = p.v JOIN p d ON d.tile = p.tile AND d.u = p.u AND d.v = p.v + 1 JOIN p e ON e.tile = p.tile AND e.u = p.u AND e.v = p.v - 1),
b AS (SELECT tile, var_pop(l) AS blur FROM l GROUP BY 1) SELECT p.tile, round(1 - avg(CAST(value <= -1 OR value >= 1.5 AS DOUBLE)), 6) AS exposure, round(any_value(blur), 5) AS blur FROM p LEFT JOIN b USING (tile) GROUP BY 1""")
def a27_sharpness_and_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda n: F.floor(c(n) * 2).cast("long")
    pixels = points(spark, sf_dir).groupBy("tile", cell("x").alias("u"), cell("y").alias("v")).agg(F.max("z").alias("value"))
    out = images.sharpness_and_exposure(pixels, -1.0, 1.5, "tile")
    return out.select("tile", *rounded(exposure=c("exposure")), *rounded(5, blur=c("blur")))


@query(f"""WITH {POINTS_SQL}, {TILES_SQL},
o AS (SELECT p.tile, coalesce(t.tile_id, -1) AS owner
  FROM points p
  LEFT JOIN tiles t ON x >= lo_u AND y >= lo_v AND (x < hi_u OR (hi_u >= 2 AND x <= hi_u)) AND (y < hi_v OR (hi_v >= 2 AND y <= hi_v)))
SELECT tile, owner, count(*) AS n FROM o GROUP BY 1, 2""")
def a44_owned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("tile", "id", c("x").alias("u"), c("y").alias("v"))
    from tracklake.operators.cloud import tile_owner

    p = tile_owner(p.withColumn("_k", F.lit(0)), _tiles(spark), 2.0, 2.0)
    return images.owned_counts(p, "tile")


@query("""WITH s AS (SELECT l_returnflag AS arm, avg(l_discount) AS before, avg(l_discount) * (1 + 0.01 * (ascii(l_returnflag) % 3)) AS after FROM lineitem GROUP BY 1)
SELECT arm, after <= before * 1.015 AS accepted FROM s""")
def a50_relative_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.operators.tables import relative_gate

    s = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("arm")).agg(F.avg("l_discount").alias("before"))
    return s.select("arm", relative_gate(c("before"), c("before") * (1 + 0.01 * (F.ascii("arm") % 3)), 0.015).alias("accepted"))


@query(f"""WITH {POINTS_SQL},
q AS (SELECT tile, z + 3 AS z, 40 * x / (z + 3) + 64 AS u, 40 * y / (z + 3) + 48 AS v FROM points)
SELECT tile, round(avg(CAST(z > 0 AND u >= 0 AND u < 128 AND v >= 0 AND v < 96 AS DOUBLE)), 9) AS share FROM q GROUP BY 1""")
def a60_seen_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("z", c("z") + 3)
    return images.seen_share(p, F.lit(40.0), F.lit(40.0), 128, 96, "tile").withColumn("share", F.round("share", 9))


@query("""WITH e AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_linestatus AS scope FROM lineitem WHERE l_quantity > 49)
SELECT a, b, scope, row_number() OVER (PARTITION BY scope ORDER BY a, b) AS place FROM e""")
def t2_canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), c("l_linestatus").alias("scope")).distinct()
    return e.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy("a", "b")).cast("long"))


@query("""WITH s AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
e AS (SELECT l_partkey AS k, sum(l_quantity + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END) AS v FROM lineitem WHERE l_partkey % 77 > 0 GROUP BY 1)
SELECT k, s.v IS NULL OR e.v IS NULL AS absent FROM s FULL JOIN e USING (k) WHERE s.v IS DISTINCT FROM e.v""")
def q8_recomputed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sums that differ from recomputed ones, or that one side lacks."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    a = rows.groupBy("k").agg(F.sum("l_quantity").alias("a"))
    b = rows.where("k % 77 > 0").groupBy("k").agg(F.sum(c("l_quantity") + F.when(c("k") % 50 == 0, 1).otherwise(0)).alias("b"))
    return a.join(b, "k", "full").where(~c("a").eqNullSafe(c("b"))).select("k", (c("a").isNull() | c("b").isNull()).alias("absent"))


@query("SELECT count(*) AS n_rows, true AS exact FROM lineitem WHERE l_orderkey % 4 = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def q10_subset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a subset taken in two ways; equal digests mean that the subset is exact."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kept = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 1").select(c("o_orderkey").alias("l_orderkey"))
    joined, filtered = rows.join(kept, "l_orderkey", "left_semi"), rows.where("l_orderkey % 4 = 1")
    a, b = (checks.table_digest(x, "l_orderkey", "l_linenumber", "l_partkey") for x in (joined, filtered.join(kept, "l_orderkey", "left_semi")))
    return a.crossJoin(b.select(c("digest").alias("other"))).select("n_rows", (c("digest") == c("other")).alias("exact"))  # one row each
