"""All events as one recording: scans, associations and pairs whose plans order no whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import geodesy
from tracklake.operators import association, chunks, selection, series
from tracklake.plans.registry import query
from tracklake.plans.time_queries import TOL
from tracklake.plans.walk_sql import decimated_sql, pairs_sql
from tracklake.sources.bindings import STREAM_SQL, stream, table

c = F.col
_ORDER = ["t_ns", "row_id"]
#: The events as one key, with a position, an angle, a value with gaps and a flag.
ONE_SQL = f"""{STREAM_SQL},
one AS (SELECT 0 AS segment_id, row_id, t_ns, kind, x / 100 AS x, k / 100.0::DOUBLE AS y, k, atan2(k / 100.0::DOUBLE - 0.5, x / 100 - 0.5) AS a, CASE WHEN k % 3 > 0 THEN x END AS v FROM stream),
stepped AS (SELECT *, row_number() OVER w AS place, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step, coalesce(abs(x - lag(x) OVER w), 0) AS dx FROM one WINDOW w AS (ORDER BY t_ns, row_id))"""


def _one(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    rows = stream(spark, sf_dir, *kinds).withColumns({"segment_id": F.lit(0), "x": c("x") / 100, "y": c("k") / 100.0, "raw": c("x")})
    return rows.withColumns({"a": F.atan2(c("y") - 0.5, c("x") - 0.5), "v": F.when(c("k") % 3 > 0, c("raw"))}).drop("raw")


@query(f"WITH {STREAM_SQL} SELECT segment_id, row_id, row_number() OVER (PARTITION BY segment_id ORDER BY t_ns, row_id) - 1 AS place FROM stream")
def t1_stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in its stream by header time, ties by the order in which they were read."""
    ordered = chunks.chunked(stream(spark, sf_dir), ["segment_id"], _ORDER)
    return chunks.with_running(ordered, F.lit(1).cast("long"), "place").rows.select("segment_id", "row_id", (c("place") - 1).alias("place"))


@query(f"""WITH {ONE_SQL}, p AS (SELECT *, sum(step) OVER (ORDER BY t_ns, row_id ROWS UNBOUNDED PRECEDING) AS path_m FROM stepped)
SELECT row_id, round(path_m, 5) AS path_m FROM p WHERE place = 1 OR floor((path_m + 1e-12) / 25) > floor((path_m - step + 1e-12) / 25)""")
def w2_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.sample_by_distance(_one(spark, sf_dir), 25.0, "segment_id", _ORDER, "x", "y")
    return out.select("row_id", F.round("path_m", 5).alias("path_m"))


@query(f"""WITH {ONE_SQL}, d AS (SELECT row_id, t_ns, a, a - lag(a) OVER (ORDER BY t_ns, row_id) AS d FROM one)
SELECT row_id, round(a + sum(CASE WHEN d > pi() THEN -2 * pi() WHEN d < -pi() THEN 2 * pi() ELSE 0 END) OVER (ORDER BY t_ns, row_id ROWS UNBOUNDED PRECEDING), 6) AS angle FROM d""")
def w10_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one(spark, sf_dir).withColumn("a", geodesy.atan2_c(c("y") - 0.5, c("x") - 0.5))
    return chunks.unwrapped(rows, "segment_id", _ORDER, "a", "angle").select("row_id", F.round("angle", 6).alias("angle"))


@query(f"""WITH {ONE_SQL}, n AS (SELECT row_id, v, place, max(CASE WHEN v IS NOT NULL THEN place END) OVER (ORDER BY place) AS lo,
  min(CASE WHEN v IS NOT NULL THEN place END) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM stepped)
SELECT n.row_id, round(CASE WHEN n.v IS NOT NULL THEN n.v WHEN n.lo IS NULL THEN b.v WHEN n.hi IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (n.place - n.lo) / (n.hi - n.lo) END, 6) AS filled
FROM n LEFT JOIN n a ON a.place = n.lo LEFT JOIN n b ON b.place = n.hi""")
def w12_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.gaps_filled(_one(spark, sf_dir), "segment_id", _ORDER, "v", "filled").select("row_id", F.round("filled", 6).alias("filled"))


@query(f"""WITH {ONE_SQL}, f AS (SELECT row_id, t_ns, k < 80 AS good FROM one),
g AS (SELECT *, row_number() OVER (ORDER BY t_ns, row_id) - row_number() OVER (PARTITION BY good ORDER BY t_ns, row_id) AS g FROM f)
SELECT good, first(row_id ORDER BY t_ns, row_id) AS first_index, last(row_id ORDER BY t_ns, row_id) AS last_index, count(*) AS n FROM g GROUP BY good, g""")
def w13_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.runs(_one(spark, sf_dir).withColumn("good", c("k") < 80), "good", "segment_id", _ORDER, "row_id").drop("segment_id")


@query(f"""WITH {ONE_SQL}, l AS (SELECT row_id, place, sum(step) OVER w AS p, sum(dx) OVER w AS r FROM stepped WINDOW w AS (ORDER BY place ROWS 99 PRECEDING))
SELECT row_id, round(p, 6) AS prior_m, round(r, 6) AS refined_m, abs(r - p) > greatest(0.5, 0.3 * p) AS failed FROM l WHERE place > 100""")
def w17_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.path_windows(_one(spark, sf_dir), "segment_id", _ORDER, 100, ("x", "y"), ("x",), 0.5, 0.3)
    return out.select("row_id", F.round("prior_m", 6).alias("prior_m"), F.round("refined_m", 6).alias("refined_m"), "failed")


@query(f"""WITH RECURSIVE {ONE_SQL},
u AS (SELECT segment_id, t_ns AS t, row_id AS i FROM one), {decimated_sql('u', 1200 * 10**9)} SELECT i AS row_id, t AS t_ns FROM walk""")
def w25_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.decimated(_one(spark, sf_dir), 1200 * 10**9, "segment_id", "t_ns", "row_id").select("row_id", "t_ns")


_SIDES = "r AS (SELECT * FROM one WHERE kind = 'click'), s AS (SELECT * FROM one WHERE kind = 'view')"


@query(f"""WITH {ONE_SQL}, {_SIDES}, u AS (SELECT t_ns, 0 AS side, row_id FROM r UNION ALL SELECT t_ns, 1, row_id FROM s),
n AS (SELECT *, last_value(CASE WHEN side = 1 THEN {{'t': t_ns, 'i': row_id}} END IGNORE NULLS) OVER w AS b,
  first_value(CASE WHEN side = 1 THEN {{'t': t_ns, 'i': row_id}} END IGNORE NULLS) OVER (ORDER BY t_ns, side, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM u WINDOW w AS (ORDER BY t_ns, side, row_id)),
k AS (SELECT row_id, t_ns, CASE WHEN b IS NOT NULL AND (a IS NULL OR t_ns - b.t <= a.t - t_ns) THEN b ELSE a END AS s FROM n WHERE side = 0)
SELECT row_id, s.i AS sample_index, s.t - t_ns AS residual_ns, coalesce(abs(s.t - t_ns) <= 20000000000, false) AS association_valid FROM k""")
def j2_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = association.nearest_with_validity(_one(spark, sf_dir, "click"), _one(spark, sf_dir, "view"), 20_000_000_000)
    return out.select("row_id", "sample_index", "residual_ns", "association_valid")


@query(f"""WITH RECURSIVE {ONE_SQL},
u AS (SELECT segment_id, CAST(kind = 'view' AS INTEGER) AS side, t_ns AS t, row_id AS i
  FROM one
  WHERE kind IN ('click', 'view')), {pairs_sql('u', 120_000_000_000)} SELECT i AS row_id, sample_index, residual_ns
  FROM met""")
def j4_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = association.one_to_one(_one(spark, sf_dir, "click"), _one(spark, sf_dir, "view"), 120_000_000_000)
    return out.select("row_id", "sample_index", "residual_ns")


@query(f"""WITH {ONE_SQL}, {_SIDES}, g AS (SELECT t_ns, row_id, CAST(sum(CAST(k < 10 AS BIGINT)) OVER (ORDER BY t_ns, row_id) AS BIGINT) AS bad, CAST(k < 10 AS BIGINT) AS own FROM s),
e AS (SELECT row_id, t_ns - {TOL // 600} AS a, t_ns + {TOL // 600} AS z FROM r),
lo AS (SELECT e.row_id, g.bad - g.own AS before FROM e ASOF JOIN g ON e.a >= g.t_ns WHERE e.a <= (SELECT max(t_ns) FROM s)),
hi AS (SELECT e.row_id, g.bad FROM e ASOF JOIN g ON e.z <= g.t_ns WHERE e.z >= (SELECT min(t_ns) FROM s))
SELECT e.row_id, coalesce(hi.bad = lo.before, false) AS supported FROM e LEFT JOIN lo USING (row_id) LEFT JOIN hi USING (row_id)""")
def j9_one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = association.supported(_one(spark, sf_dir, "click"), _one(spark, sf_dir, "view"), c("k") >= 10, TOL // 600, TOL // 600)
    return out.select("row_id", "supported")


@query("""SELECT count(*) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
  max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean FROM lineitem""")
def a3_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of all line items as one group."""
    out = selection.distribution(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.select("n", "min", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "max", F.round("mean", 4).alias("mean"))


@query("""WITH r AS (SELECT l_quantity - 25 + l_discount * 10 AS e FROM lineitem)
SELECT count(*) AS n, round(quantile_cont(abs(e), 0.5), 6) AS median_abs, round(max(abs(e)), 6) AS max_abs, round(avg(e), 6) AS mean FROM r""")
def a1_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((c("l_quantity") - 25 + c("l_discount") * 10).alias("e"))
    return selection.residual_summary(rows, "e").select("n", *[F.round(v, 6).alias(v) for v in ("median_abs", "max_abs", "mean")])


@query("""WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y, l_discount - 0.05 AS z FROM lineitem)
SELECT round(quantile_cont(x, 0.01) - 1, 6) AS low_x, round(quantile_cont(x, 0.99) + 1, 6) AS high_x, round(quantile_cont(y, 0.01) - 1, 4) AS low_y, round(quantile_cont(y, 0.99) + 1, 4) AS high_y,
  round(quantile_cont(z, 0.01) - 1, 6) AS low_z, round(quantile_cont(z, 0.99) + 1, 6) AS high_z FROM p""")
def p19_one_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(c("l_quantity").cast("double").alias("x"), c("l_extendedprice").cast("double").alias("y"), (c("l_discount") - 0.05).cast("double").alias("z"))
    out = selection.crop_box(rows, 1.0)
    return out.select(*[F.round(f"{n}_{v}", 4 if v == "y" else 6).alias(f"{n}_{v}") for v in "xyz" for n in ("low", "high")])


@query("""WITH r AS (SELECT l_returnflag, sqrt(pow(l_discount * 3, 2) + pow(l_tax * 2, 2)) AS e, pow(l_discount * 3, 2) / 0.01 + pow(l_tax * 2, 2) / 0.04 AS m FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(quantile_cont(e, 0.5), 6) AS median_m, round(quantile_cont(e, 0.95), 6) AS p95_m, round(avg(CAST(e <= 0.2 AS DOUBLE)), 6) AS inlier_share,
  round(quantile_cont(CASE WHEN e <= 0.2 THEN e END, 0.95), 6) AS inlier_p95_m, round(quantile_cont(m, 0.5), 6) AS median_mahalanobis2, round(avg(CAST(m <= 7.8147 AS DOUBLE)), 6) AS chi2_share FROM r GROUP BY 1""")
def a12_long_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of all line items in three groups."""
    a, b = c("l_discount").cast("double") * 3, c("l_tax").cast("double") * 2
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.sqrt(a * a + b * b).alias("residual_m"), (a * a / 0.01 + b * b / 0.04).alias("m"))
    out = selection.residual_quality(rows, F.lit(0.2), c("m"), "l_returnflag")
    return out.select("l_returnflag", "n", *[F.round(v, 6).alias(v) for v in ("median_m", "p95_m", "inlier_share", "inlier_p95_m", "median_mahalanobis2", "chi2_share")])
