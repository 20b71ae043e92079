"""Contract checks of a segment's tables, registration and rig summaries, scene completeness: rows of what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.scans import spread


def violations(key: str, *rules: tuple[str, DataFrame]) -> DataFrame:
    """(key, rule, n) of the rules that have violating rows."""
    parts = [rows.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(name).alias("rule"), "n") for name, rows in rules]
    return reduce(DataFrame.unionByName, parts)


def frame_contract(frames: DataFrame, split: DataFrame, key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """Frames numbered from 0 without gaps, times rising, right stamps and residuals agreeing, each frame in one split."""
    w = Window.partitionBy(key).orderBy(index)
    numbered = frames.withColumn("_k", F.row_number().over(w) - 1).withColumn("_before", F.lag(time).over(w))
    parts = split.groupBy(key, index).agg(F.count("*").alias("_n"))
    joined = frames.join(parts, [key, index], "full")
    rules = [
        ("frames_contiguous", numbered.where(F.col("_k") != F.col(index))),
        ("times_rise", numbered.where(F.col(time) <= F.col("_before"))),
        ("split_covers", joined.where(F.col(time).isNull() | F.col("_n").isNull() | (F.col("_n") > 1))),
    ]
    if "right_t_ns" in frames.columns:
        rules.append(("sync_residual", frames.where(F.col("right_t_ns") - F.col(time) != F.col("sync_residual_ns"))))
    return violations(key, *rules)


def association_contract(observations: DataFrame, raw: DataFrame, key: str = "segment_id") -> DataFrame:
    """Observations whose source time isn't the raw row's, or whose residual isn't source minus frame time."""
    r = raw.select(key, "source_index", F.col("t_ns").alias("_raw"))
    joined = observations.join(r, [key, "source_index"], "left")
    wrong = F.col("_raw").isNull() | (F.col("_raw") != F.col("source_t_ns")) | (F.col("source_t_ns") - F.col("t_ns") != F.col("residual_ns"))
    return joined.where(wrong).drop("_raw")


def pose_valid(m: tuple[Column, ...], tolerance: float = 1e-6) -> Column:
    """A row-major 4x4 matrix is a rigid motion: orthonormal rotation of determinant 1, last row 0 0 0 1, all finite."""
    r = [m[4 * i + j] for i in range(3) for j in range(3)]
    good = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            good = good & (F.abs(sum((r[3 * i + k] * r[3 * j + k] for k in (1, 2)), r[3 * i] * r[3 * j]) - (1.0 if i == j else 0.0)) <= tolerance)
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    good = good & (F.abs(det - 1) <= tolerance) & (m[12] == 0) & (m[13] == 0) & (m[14] == 0) & (m[15] == 1)
    for x in m[:12]:
        good = good & ~F.isnan(x)
    return F.coalesce(good, F.lit(False))


def topics_missing(chunks: DataFrame, required: list[str], key: str) -> DataFrame:
    """Chunks that lack required topics or hold no time."""
    lacking = F.array_except(F.array(*[F.lit(t) for t in required]), "topics")
    return chunks.select(key, F.array_join(F.array_sort(lacking), ",").alias("lacking"), (F.col("stop_ns") <= F.col("start_ns")).alias("empty")).where("lacking <> '' or empty")


def registration(expected: DataFrame, registered: DataFrame, name: str, *keys: str) -> DataFrame:
    """n_expected, n_registered, n_missing, n_unexpected, share of each key."""
    e, r = expected.select(*keys, name).distinct().withColumn("_e", F.lit(1)), registered.select(*keys, name).distinct().withColumn("_r", F.lit(1))
    j = e.join(r, [*keys, name], "full")
    out = j.groupBy(*keys).agg(F.count("_e").alias("n_expected"), F.count("_r").alias("n_registered"), F.count_if(F.col("_r").isNull()).alias("n_missing"), F.count_if(F.col("_e").isNull()).alias("n_unexpected"))
    return out.withColumn("share", (F.col("n_expected") - F.col("n_missing")) / F.when(F.col("n_expected") > 0, F.col("n_expected")))


def rig_state(images: DataFrame, rig_size: int, key: str, frame: str, camera: str) -> DataFrame:
    """State of each frame by its distinct cameras: singleton, partial, complete, or duplicate if a camera comes twice."""
    n = spread(images.select(key, frame, camera), key, frame).groupBy(key, frame).agg(F.count("*").alias("n"), F.count_distinct(camera).alias("cameras"))
    state = F.when(F.col("n") > F.col("cameras"), "duplicate").when(F.col("cameras") == rig_size, "complete").when(F.col("cameras") == 1, "singleton").otherwise("partial")
    return n.select(key, frame, "n", state.alias("state"))


def leaking_roles(local: DataFrame, overall: DataFrame, rejected: DataFrame, key: str, frame: str) -> DataFrame:
    """Rows of local roles that use what must stay unseen: overall holdouts that calibrate, and rejected rows with any role."""
    j = local.join(overall.select(key, frame, F.col("role").alias("_overall")), [key, frame], "left").join(rejected.select(key, frame).distinct().withColumn("_out", F.lit(True)), [key, frame], "left")
    problem = F.when(F.col("_out"), "rejected").when((F.col("_overall") == "holdout") & (F.col("role") == "calibration"), "holdout calibrates")
    return j.withColumn("problem", problem).where("problem is not null").drop("_overall", "_out")


def scene_completeness(planned: DataFrame, run: DataFrame, owned: DataFrame, source_count: int, views: DataFrame) -> DataFrame:
    """One row of booleans: tiles_run, all_owned (owned and outside rows are the source's), each_contributes, views_once, metrics_finite."""
    tiles = planned.select("tile_id").distinct().join(run.select("tile_id").distinct().withColumn("_run", F.lit(1)), "tile_id", "left").agg(F.coalesce(F.bool_and(F.col("_run").isNotNull()), F.lit(False)).alias("tiles_run"))
    own = owned.agg((F.sum("n") == source_count).alias("all_owned"))
    part = planned.join(owned.where("tile_id >= 0").select("tile_id", "n"), "tile_id", "left").agg(F.coalesce(F.bool_and(F.coalesce("n", F.lit(0)) > 0), F.lit(False)).alias("each_contributes"))
    seen = views.groupBy("view").agg(F.count("*").alias("n"), F.bool_and(F.col("metric").isNotNull() & ~F.isnan("metric")).alias("ok")).agg(F.bool_and(F.col("n") == 1).alias("views_once"), F.bool_and("ok").alias("metrics_finite"))
    return tiles.crossJoin(own).crossJoin(part).crossJoin(seen)  # one row each


def relative_gate(before: Column, after: Column, max_loss: float) -> Column:
    """Whether a value got worse (larger) by no more than a share of what it was."""
    return F.coalesce(after <= before * (1 + max_loss), F.lit(False))


def repaired(source: DataFrame, candidate: DataFrame, *keys: str) -> DataFrame:
    """Failed checks of the source, whether the candidate passes them and moved towards the bound that failed."""
    a = source.where("not passed").select(*keys, "name", F.col("value").alias("before"), "minimum", "maximum")
    b = candidate.select(*keys, "name", F.col("value").alias("after"), F.col("passed").alias("now_passed"))
    j = a.join(b, [*keys, "name"], "left")
    better = F.when(F.col("before") < F.col("minimum"), F.col("after") > F.col("before")).when(F.col("before") > F.col("maximum"), F.col("after") < F.col("before"))
    return j.withColumn("repaired", F.coalesce(F.col("now_passed") & better, F.lit(False))).drop("minimum", "maximum")
