"""Calibration, colour correction, models and depths in files, and the migration of an old layout, over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import rotation
from tracklake.operators import acceptance, calibration, cloud
from tracklake.operators.pairs import checkpointed
from tracklake.plans.registry import query
from tracklake.plans.space_queries import rounded
from tracklake.plans.time_queries import QUALITY, TOL
from tracklake.sources import readers
from tracklake.sources.bindings import POINTS_SQL, STREAM_SQL, TRACK_SQL, points, stream, table, track

c = F.col


# ---- files

@query(f"""WITH {POINTS_SQL}, n AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'twice' ELSE 'p' || id END AS name, x, y, z, w / 10 AS h FROM points),
m AS (SELECT *, count(*) OVER (PARTITION BY id // 200, name) AS n, CASE WHEN id % 13 > 0 THEN (1 - h * h) / (1 + h * h) END AS a, CASE WHEN id % 13 > 0 THEN 2 * h / (1 + h * h) END AS b FROM n)
SELECT name, round(-(a * x + b * y), 6) AS x, round(b * x - a * y, 6) AS y, round(CASE WHEN id % 13 > 0 THEN -z END, 6) AS z, CASE WHEN id % 13 = 0 THEN 'number' WHEN n > 1 THEN 'repeated' END AS problem FROM m""")
def src5_pose_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of 200 poses each, written as text and read back: empty observations, empty lines and comments between."""
    checkpointed(spark.range(1))  # names the shared folder
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/models-{uuid.uuid4().hex}"
    qz = F.when(c("id") % 13 == 0, "x").otherwise((c("w") / 10).cast("string"))
    name = F.when(c("id") % 7 == 0, "twice").otherwise(F.concat(F.lit("p"), "id"))
    pose = F.concat_ws(" ", "id", F.lit("1.0"), F.lit("0.0"), F.lit("0.0"), qz, "x", "y", "z", F.lit("1"), name)
    before = F.when(c("id") % 5 == 0, "\n# a comment\n").otherwise("")
    seen = F.when(c("id") % 3 == 0, "").otherwise("12.5 7.25 -1 80.0 9.5 44")
    rows = points(spark, sf_dir).select(F.floor(c("id") / 200).alias("model"), F.struct("id", F.concat(before, pose, F.lit("\n"), seen).alias("t")).alias("s"))
    texts = rows.groupBy("model").agg(F.array_sort(F.collect_list("s")).alias("s")).select("model", F.array_join(F.transform("s", lambda s: s["t"]), "\n").alias("value"))
    texts.write.partitionBy("model").text(path)
    return readers.pose_model(spark, path).select("name", *rounded(x=c("x"), y=c("y"), z=c("z")), "problem")


_DEPTHS = """d AS (SELECT vec_id AS id, u, v, abs(CAST(embedding[v * 8 + u + 1] AS DOUBLE)) AS z, embedding[v * 8 + u + 1] > -0.1 AS ok
  FROM embeddings, (SELECT unnest([1, 4, 7]) AS u), (SELECT unnest([1, 4, 7]) AS v)), px AS (SELECT id, u, v, z FROM d WHERE ok AND z >= 0.01)"""


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.transform("embedding", lambda e: F.abs(e.cast("double")))
    frames = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), depth.alias("depth"), F.transform("embedding", lambda e: e > -0.1).alias("valid"))
    return cloud.depth_pixels(frames, 3, 0.01, "id")


@query(f"WITH {_DEPTHS} SELECT id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, round(z, 6) AS z FROM px")
def src8_depth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is a depth map of eight by eight."""
    return _depths(spark, sf_dir).select("id", "u", "v", F.round("z", 6).alias("z"))


@query(f"""WITH {POINTS_SQL}, {_DEPTHS}, b AS (SELECT px.id, px.id * 64 + px.v * 8 + px.u AS rank, (px.u - 3.5) * px.z / 4 AS bx, (px.v - 3.5) * px.z / 5 AS by_, px.z AS bz, p.u AS a, p.x, p.y, p.z FROM px JOIN points p USING (id)),
w AS (SELECT rank, cos(a) * bx - sin(a) * by_ + x AS x, sin(a) * bx + cos(a) * by_ + y AS y, bz + z AS z FROM b)
SELECT rank, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM w QUALIFY row_number() OVER (PARTITION BY floor(x / 0.5), floor(y / 0.5), floor(z / 0.5) ORDER BY rank) = 1""")
def c12_initial_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth pixels of cameras at the points, turned about z by u, in the world; the first of each half metre stays."""
    seen = _depths(spark, sf_dir)
    bx, by, bz = cloud.back_projected(c("u"), c("v"), c("z"), F.lit(4.0), F.lit(5.0), F.lit(3.5), F.lit(3.5))
    camera = points(spark, sf_dir).select("id", c("u").alias("a"), c("x").alias("cx"), c("y").alias("cy"), c("z").alias("cz"))
    rows = seen.select("id", (c("id") * 64 + c("v") * 8 + c("u")).alias("rank"), bx.alias("bx"), by.alias("by"), bz.alias("bz")).join(camera, "id")
    r = rotation.matrix((F.lit(0.0), F.lit(0.0), F.sin(c("a") / 2), F.cos(c("a") / 2)))
    world = [r[3 * k] * c("bx") + r[3 * k + 1] * c("by") + r[3 * k + 2] * c("bz") + c(f"c{axis}") for k, axis in enumerate("xyz")]
    kept = cloud.voxel_first(rows.select("rank", *[v.alias(n) for n, v in zip("xyz", world, strict=True)]), 0.5, "rank")
    return kept.select("rank", *rounded(x=c("x"), y=c("y"), z=c("z")))


# ---- colours

_ORTHOGONAL = f"""{POINTS_SQL}, p AS (SELECT tile % 2 AS view, 1 / (1 + exp(-x)) AS a0, 1 / (1 + exp(-y)) AS a1, 1 / (1 + exp(-z)) AS a2, 1 / (1 + exp(-x - u)) AS b0, 1 / (1 + exp(-y - 2 * v)) AS b1, 1 / (1 + exp(-w)) AS b2 FROM points),
e AS (SELECT *, a0 - avg(a0) OVER w AS f FROM p WINDOW w AS (PARTITION BY view)),
g AS (SELECT *, a1 - avg(a1) OVER w - f * (covar_pop(a1, f) OVER w / var_pop(f) OVER w) AS g FROM e WINDOW w AS (PARTITION BY view)),
h AS (SELECT *, a2 - avg(a2) OVER w - f * (covar_pop(a2, f) OVER w / var_pop(f) OVER w) - g * (covar_pop(a2, g) OVER w / var_pop(g) OVER w) AS h FROM g WINDOW w AS (PARTITION BY view)),
k AS (SELECT view, """ + ", ".join(
    f"b{k}, greatest(0, least(1, avg(b{k}) OVER w + f * (covar_pop(b{k}, f) OVER w / var_pop(f) OVER w) + g * (covar_pop(b{k}, g) OVER w / var_pop(g) OVER w) + h * (covar_pop(b{k}, h) OVER w / var_pop(h) OVER w))) AS c{k}" for k in range(3)
) + " FROM h WINDOW w AS (PARTITION BY view))"


@query(f"""WITH {_ORTHOGONAL} SELECT view, round(-10 * log10((avg(pow(c0 - b0, 2)) + avg(pow(c1 - b1, 2)) + avg(pow(c2 - b2, 2))) / 3), 5) AS psnr FROM k GROUP BY 1""")
def a29_corrected_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours are logistic in the points; the SQL makes the three channels orthogonal one after the other."""
    level = lambda x: 1 / (1 + F.exp(-x))
    values = {"a0": c("x"), "a1": c("y"), "a2": c("z"), "b0": c("x") + c("u"), "b1": c("y") + 2 * c("v"), "b2": c("w")}
    pixels = points(spark, sf_dir).select((c("tile") % 2).alias("view"), *[level(v).alias(k) for k, v in values.items()])
    fixed = calibration.color_corrected(pixels, "view")
    channels = fixed.select("view", F.inline(F.array(*[F.struct(c(f"a{k}").alias("a"), c(f"b{k}").alias("b")) for k in range(3)])))
    return cloud.psnr(channels, "view").withColumn("psnr", F.round("psnr", 5))


# ---- clocks and rigs

@query()
def a32_clock_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at views against those at clicks turned by a quarter, over nine offsets of four hours."""
    place = lambda kind: stream(spark, sf_dir, kind).withColumns({"px": c("t_ns") / 1e14, "py": c("x") / 100, "pz": (c("k") % 7).cast("double")})
    reference = place("click").select("segment_id", "row_id", "t_ns", (-c("py")).alias("u"), c("px").alias("v"), c("pz").alias("w"))
    sample = place("view").select("segment_id", "row_id", "t_ns", c("px").alias("x"), c("py").alias("y"), c("pz").alias("z"))
    offsets = [h * 4 * 3600 * 1_000_000_000 for h in range(-4, 5)]
    out = calibration.clock_profile(reference, sample, offsets, 4 * 10**14)
    return calibration.profile_summary(out.select("segment_id", "offset_ns", "n", F.round("cost", 9).alias("cost")), "segment_id")


_HOURS = 4 * 3600 * 1_000_000_000
#: The start of the events' month, to keep coordinates small.
_START = 1_704_067_200_000_000_000


# In a plane the best turn in space is the better one of the best turn and the best reflection, which are known in closed form.
@query(f"""WITH {STREAM_SQL}, p AS (SELECT segment_id, row_id, kind, t_ns, (t_ns - {_START}) / 1e14 AS px, x / 100 AS py FROM stream),
s AS (SELECT * FROM p WHERE kind = 'view'),
m AS (SELECT segment_id, row_id, o, t_ns + o * {_HOURS} AS moved, -py AS u, px AS v FROM p, (SELECT unnest(range(-4, 5)) AS o) WHERE kind = 'click'),
i AS (SELECT m.segment_id, m.o, m.u, m.v, CASE WHEN h.t_ns > l.t_ns THEN (m.moved - l.t_ns) / (h.t_ns - l.t_ns) ELSE 0 END AS f, l.px AS lx, l.py AS ly, h.px AS hx, h.py AS hy
  FROM m ASOF JOIN s l ON m.segment_id = l.segment_id AND m.moved >= l.t_ns ASOF JOIN s h ON m.segment_id = h.segment_id AND m.moved <= h.t_ns WHERE h.t_ns - l.t_ns <= 400000000000000),
q AS (SELECT segment_id, o, u, v, lx + f * (hx - lx) AS x, ly + f * (hy - ly) AS y FROM i),
c AS (SELECT *, x - avg(x) OVER g AS a, y - avg(y) OVER g AS b, u - avg(u) OVER g AS d, v - avg(v) OVER g AS e FROM q WINDOW g AS (PARTITION BY segment_id, o)),
k AS (SELECT segment_id, o, round((sum(a * a + b * b + d * d + e * e) - 2 * greatest(sqrt(pow(sum(a * d + b * e), 2) + pow(sum(a * e - b * d), 2)), sqrt(pow(sum(a * d - b * e), 2) + pow(sum(a * e + b * d), 2)))) / count(*), 7) AS cost
  FROM c GROUP BY 1, 2 HAVING count(*) >= 3),
w AS (SELECT *, row_number() OVER z AS place, count(*) OVER (PARTITION BY segment_id) AS n, lag(cost) OVER z AS before, lead(cost) OVER z AS after, row_number() OVER (PARTITION BY segment_id ORDER BY cost, o) AS r FROM k WINDOW z AS (PARTITION BY segment_id ORDER BY o)),
y AS (SELECT segment_id, max(n) AS n, max(CASE WHEN r = 1 THEN o END) AS o, max(CASE WHEN r = 1 THEN place END) AS place, max(CASE WHEN r = 1 THEN cost END) AS best, max(CASE WHEN r = 2 THEN cost END) AS second,
  max(CASE WHEN r = 1 THEN least(before, after) END) AS beside, least(max(CASE WHEN place = 1 THEN cost END), max(CASE WHEN place = n THEN cost END)) AS ends FROM w GROUP BY 1)
SELECT segment_id, o AS best_offset, place > 1 AND place < n AS interior, round((ends - best) / greatest(ends, 1e-12), 4) AS "drop", round((second - best) / greatest(best, 1e-12), 4) AS separation,
  round(CASE WHEN place > 1 AND place < n THEN (beside - best) / greatest(best, 1e-12) ELSE 0 END, 4) AS prominence FROM y WHERE best > 0.001""")
def a32_planar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile over nine offsets of four hours in a plane, of recordings that don't fit exactly; offsets in steps."""
    place = lambda kind: stream(spark, sf_dir, kind).withColumns({"px": (c("t_ns") - _START) / 1e14, "py": c("x") / 100})
    reference = place("click").select("segment_id", "row_id", "t_ns", (-c("py")).alias("u"), c("px").alias("v"), F.lit(0.0).alias("w"))
    sample = place("view").select("segment_id", "row_id", "t_ns", c("px").alias("x"), c("py").alias("y"), F.lit(0.0).alias("z"))
    out = calibration.clock_profile(reference, sample, [h * _HOURS for h in range(-4, 5)], 4 * 10**14)
    curve = out.select("segment_id", "offset_ns", F.round("cost", 7).alias("cost"))
    fits = curve.groupBy("segment_id").agg(F.min("cost").alias("best")).where("best > 0.001").select("segment_id")
    found = calibration.profile_summary(curve.join(fits, "segment_id"), "segment_id")
    return found.select("segment_id", (c("best_offset") / _HOURS).cast("long").alias("best_offset"), "interior", *rounded(4, drop=c("drop"), separation=c("separation"), prominence=c("prominence")))


_CURVE = f"""{TRACK_SQL}, e AS (SELECT segment_id, frame, y AS cost, row_number() OVER (PARTITION BY segment_id ORDER BY y, frame) AS r, count(*) OVER (PARTITION BY segment_id) AS n,
  lag(y) OVER w AS before, lead(y) OVER w AS after FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY frame)),
s AS (SELECT segment_id, max(n) AS n, max(CASE WHEN r = 1 THEN frame END) AS best_offset, max(CASE WHEN r = 1 THEN cost END) AS best, max(CASE WHEN r = 2 THEN cost END) AS second,
  max(CASE WHEN r = 1 THEN least(before, after) END) AS beside, least(max(CASE WHEN frame = 0 THEN cost END), max(CASE WHEN frame = n - 1 THEN cost END)) AS ends FROM e GROUP BY 1)"""


@query(f"""WITH {_CURVE} SELECT segment_id, best_offset, best_offset > 0 AND best_offset < n - 1 AS interior, round((ends - best) / greatest(ends, 1e-12), 6) AS "drop", round((second - best) / greatest(best, 1e-12), 6) AS separation,
  round(CASE WHEN best_offset > 0 AND best_offset < n - 1 THEN (beside - best) / greatest(best, 1e-12) ELSE 0 END, 6) AS prominence FROM s""")
def a32_profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames stand for the offsets and y for the costs."""
    out = calibration.profile_summary(track(spark, sf_dir), "segment_id", offset="frame", cost="y")
    return out.select("segment_id", "best_offset", "interior", *rounded(drop=c("drop"), separation=c("separation"), prominence=c("prominence")))


#: A turn and a shift of the whole are nuisances; lever arm, two mount angles and a clock offset are asked for.
RIG_STEPS = (*[1e-6] * 3, *[1e-5] * 6, 1e-6, 1e-6, 1e-4)
RIG_PRIOR = (0.5, 0.5, 0.5, 0.1, 0.1, 0.05)


def rig_residual(p: list[float]) -> list[F.Column]:
    """Antenna positions and baselines of a vehicle at (x, y, z) with heading u and speed (v, w), to first order in turns."""
    rx, ry, rz, tx, ty, tz, lx, ly, lz, yaw, pitch, dt = p
    cos, sin = F.cos("u"), F.sin("u")
    ax, ay, az = c("x") + cos * lx - sin * ly + dt * c("v"), c("y") + sin * lx + cos * ly + dt * c("w"), c("z") + lz
    turned = [ax + ry * az - rz * ay + tx, ay + rz * ax - rx * az + ty, az + rx * ay - ry * ax + tz]
    line = [F.cos(c("u") + yaw + rz), F.sin(c("u") + yaw + rz), F.lit(pitch) + rx * sin - ry * cos]
    return [*[v / 0.05 for v in turned], *[v / 0.02 for v in line]]


@query()
def a33_observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the points of a tile tell about a rig: height of the lever arm isn't told from the height of the whole."""
    out = calibration.observability(points(spark, sf_dir), rig_residual, [0.0] * 12, RIG_STEPS, RIG_PRIOR, "tile")
    names = ("lever_x", "lever_y", "lever_z", "yaw", "pitch", "clock")
    return out.select("tile", "n", "nuisance_rank", "rank", *[F.round(F.element_at("posterior_sigma", k + 1), 6).alias(n) for k, n in enumerate(names)])


@query()
def a35_block_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in five blocks against themselves turned, moved and disturbed."""
    rows = points(spark, sf_dir).select((c("tile") % 2).alias("field"), (c("id") % 5).alias("block"), "x", "y", "z", (3 - c("y") + c("u") / 50).alias("u"), (c("x") + c("v") / 50).alias("v"), (c("z") - 7).alias("w"))
    out = calibration.block_cross_validation(rows, "block", "field")
    return out.select("field", "block", "n", "n_training", *rounded(median_m=c("median_m"), p95_m=c("p95_m"), max_m=c("max_m")))


@query(f"""WITH {POINTS_SQL}, p AS (SELECT id % 5 AS block, x, y, 3 - y + u / 50 AS u, x + v / 50 AS v FROM points),
t AS (SELECT b.block, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM (SELECT DISTINCT block FROM p) b JOIN p ON p.block <> b.block GROUP BY 1),
m AS (SELECT t.block, atan2(sum((x - mx) * (v - mv) - (y - my) * (u - mu)), sum((x - mx) * (u - mu) + (y - my) * (v - mv))) AS a FROM t JOIN p ON p.block <> t.block GROUP BY 1),
e AS (SELECT t.block, t.n, sqrt(pow(u - mu - (cos(a) * (x - mx) - sin(a) * (y - my)), 2) + pow(v - mv - (sin(a) * (x - mx) + cos(a) * (y - my)), 2)) AS e FROM p JOIN t USING (block) JOIN m USING (block))
SELECT block, count(*) AS n, any_value(e.n) AS n_training, round(quantile_cont(e, 0.5), 6) AS median_m, round(quantile_cont(e, 0.95), 6) AS p95_m, round(max(e), 6) AS max_m FROM e GROUP BY 1""")
def a35_planar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As before, in a plane, where the best turn is known in closed form."""
    zero = F.lit(0.0)
    rows = points(spark, sf_dir).select((c("id") % 5).alias("block"), "x", "y", zero.alias("z"), (3 - c("y") + c("u") / 50).alias("u"), (c("x") + c("v") / 50).alias("v"), zero.alias("w"))
    out = calibration.block_cross_validation(rows, "block")
    return out.select("block", "n", "n_training", *rounded(median_m=c("median_m"), p95_m=c("p95_m"), max_m=c("max_m")))


# ---- inputs of a calibration, an old layout

_FIXES = f"""{STREAM_SQL}, f AS (SELECT * FROM stream WHERE kind = 'view' QUALIFY row_number() OVER (PARTITION BY segment_id, t_ns ORDER BY row_id) = 1),
m AS (SELECT f.*, s.k AS sk, abs(s.t_ns - f.t_ns) AS age_ns FROM f LEFT JOIN (SELECT * FROM stream WHERE kind = 'click') s ON s.segment_id = f.segment_id AND abs(s.t_ns - f.t_ns) <= {TOL}
  QUALIFY row_number() OVER (PARTITION BY f.row_id ORDER BY abs(s.t_ns - f.t_ns), s.t_ns, s.row_id) = 1),
l AS (SELECT *, radians(40 + x / 1000) AS p, radians(5 + k / 100.0::DOUBLE) AS q, 6378137.0::DOUBLE AS ea, 0.00669437999014::DOUBLE AS e2, radians(40) AS p0, radians(5) AS q0 FROM m),
n AS (SELECT *, ea / sqrt(1 - e2 * sin(p) * sin(p)) AS n, ea / sqrt(1 - e2 * sin(p0) * sin(p0)) AS n0 FROM l),
d AS (SELECT *, (n + k) * cos(p) * cos(q) - n0 * cos(p0) * cos(q0) AS dx, (n + k) * cos(p) * sin(q) - n0 * cos(p0) * sin(q0) AS dy, (n * (1 - e2) + k) * sin(p) - n0 * (1 - e2) * sin(p0) AS dz FROM n)"""


@query(f"""WITH {_FIXES} SELECT segment_id, row_id, t_ns, round(-sin(q0) * dx + cos(q0) * dy, 4) AS east, round(-sin(p0) * cos(q0) * dx - sin(p0) * sin(q0) * dy + cos(p0) * dz, 4) AS north,
  round(cos(p0) * cos(q0) * dx + cos(p0) * sin(q0) * dy + sin(p0) * dz, 4) AS up, age_ns, coalesce(k % 4 - 1 >= 0 AND k % 3 > 0 AND sk % 5 > 0, false) AS good FROM d""")
def c15_calibration_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = stream(spark, sf_dir, "view").withColumns({"lat": 40 + c("x") / 1000, "lon": 5 + c("k") / 100.0, "alt": c("k") * 1.0, "status": c("k") % 4 - 1, "covariance_type": c("k") % 3, "variance": c("x")})
    states = stream(spark, sf_dir, "click").withColumn("ok", c("k") % 5 > 0)
    out = acceptance.calibration_fixes(fixes, states, (40.0, 5.0, 0.0), TOL)
    return out.withColumns({v: F.round(v, 4) for v in ("east", "north", "up")})


@query(f"""WITH {STREAM_SQL}, f AS (SELECT row_id, t_ns, CASE WHEN row_id % 50 < 2 THEN 'f' || row_id // 50 ELSE 'n' || row_id END AS name, k FROM stream WHERE kind = 'click'),
r AS (SELECT DISTINCT name, CASE k % 3 WHEN 0 THEN 'holdout' ELSE 'calibration' END AS role FROM f UNION SELECT name, 'excluded' FROM f WHERE k % 10 = 0),
h AS (SELECT name, bool_or(role = 'calibration') AS held, count(DISTINCT role) > 1 AS mixed FROM r GROUP BY 1), lo AS (SELECT min(t_ns) AS t FROM f),
w AS (SELECT name, row_id, t_ns, mixed, count(*) OVER (PARTITION BY name) > 1 AS same FROM f JOIN h USING (name), lo WHERE held AND t_ns BETWEEN t + 86400000000000 AND t + 2000000000000000)
SELECT name, row_id, CASE WHEN mixed THEN 'roles' WHEN same THEN 'frames' END AS problem FROM w""")
def c15_calibration_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from a day after the first on, for 22 days; some names repeat, some have several roles."""
    name = F.when(c("row_id") % 50 < 2, F.concat(F.lit("f"), F.floor(c("row_id") / 50))).otherwise(F.concat(F.lit("n"), "row_id"))
    frames = stream(spark, sf_dir, "click").select("row_id", "t_ns", "k", name.alias("name"))
    roles = frames.select("name", F.when(c("k") % 3 == 0, "holdout").otherwise("calibration").alias("role")).union(frames.where("k % 10 = 0").select("name", F.lit("excluded")))
    first = frames.agg(F.min("t_ns").alias("_first"))  # one row
    held = frames.crossJoin(F.broadcast(first))
    out = acceptance.calibration_frames(held, roles, c("_first") + 86_400_000_000_000, c("_first") + 2_000_000_000_000_000)
    return out.select("name", "row_id", "problem")


def _near(left: str, right: str) -> str:
    return f"""(SELECT l.segment_id, l.row_id, s.row_id AS found, s.t_ns - l.t_ns AS residual, s.k AS k, s.x AS x FROM (SELECT * FROM stream WHERE kind = '{left}') l
  LEFT JOIN (SELECT * FROM stream WHERE kind = '{right}') s ON s.segment_id = l.segment_id AND abs(s.t_ns - l.t_ns) <= {4 * TOL}
  QUALIFY row_number() OVER (PARTITION BY l.row_id ORDER BY abs(s.t_ns - l.t_ns), s.t_ns, s.row_id) = 1)"""


@query(f"""WITH {STREAM_SQL}, x AS (SELECT f.segment_id, f.row_id, f.found, f.residual, f.x AS raw_x, st.found AS state_index, h.found AS heading_index, f.k % 4 - 1 AS status, coalesce(st.k % 3, -1) AS carrier,
  coalesce(h.k & 1 > 0 AND h.k & 2 > 0 AND h.k & 4 > 0 AND h.k & 8 = 0 AND h.k % 3 >= 2 AND h.x >= 1, false) AS heading_valid
  FROM {_near('click', 'view')} f LEFT JOIN {_near('view', 'purchase')} st ON st.row_id = f.found JOIN {_near('click', 'error')} h ON h.row_id = f.row_id)
SELECT segment_id, row_id, found AS source_index, residual AS source_residual_ns, raw_x, state_index, heading_index, heading_valid, CASE WHEN found IS NULL THEN 'fix' WHEN state_index IS NULL THEN 'state' WHEN heading_index IS NULL THEN 'heading' END AS problem,
  coalesce(status >= 0, false) AS position_valid, CASE WHEN found IS NULL THEN 'invalid' ELSE {QUALITY} END AS position_quality FROM x""")
def q5_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are frames, views fixes, purchases receiver states, errors headings."""
    bit = lambda n: c("k").bitwiseAND(n) > 0
    flags = F.array(bit(1), bit(2), bit(4), F.lit(True), bit(8), F.lit(False), F.lit(True), F.lit(False))
    fixes = stream(spark, sf_dir, "view").select("segment_id", "row_id", "t_ns", (c("k") % 4 - 1).alias("status"), c("x").isNotNull().alias("finite"), "x")
    states = stream(spark, sf_dir, "purchase").select("segment_id", "row_id", "t_ns", (c("k") % 3).alias("carrier"))
    headings = stream(spark, sf_dir, "error").select("segment_id", "row_id", "t_ns", flags.alias("flags"), (c("k") % 3).alias("heading_carrier"), (c("x") - 1).alias("accuracy"))
    out = acceptance.migrated(stream(spark, sf_dir, "click").select("segment_id", "row_id", "t_ns"), fixes, states, headings, 4 * TOL)
    return out.select("segment_id", "row_id", "source_index", "source_residual_ns", "raw_x", "state_index", "heading_index", "heading_valid", "problem", "position_valid", "position_quality")
