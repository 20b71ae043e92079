"""Recordings, tile plans and depth carried to another camera, restated in plain Python."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from tracklake.operators import acceptance, composites, planning, scenes
from tracklake.sources import readers

STREAM = "segment_id int, row_id long, t_ns long"


def test_stereo_pairs_take_the_first_problem(spark):
    left = spark.createDataFrame([(1, i, 100 * i) for i in range(6)], STREAM)
    right = spark.createDataFrame([(1, 10 + i, 100 * i + 1) for i in range(6) if i != 2], STREAM)
    fixes = spark.createDataFrame([(1, 20, 0, 1.0, 2.0, 3.0, 2, 2), (1, 21, 305, 1.0, 2.0, 3.0, -1, 2), (1, 22, 405, 1.0, 2.0, 3.0, 0, 1)], STREAM + ", x double, y double, z double, status int, carrier int")
    good = [True, True, True, True, False, False, True, False]
    headings = spark.createDataFrame([(1, 30, 0, np.pi / 2, good, 2, 0.1), (1, 31, 400, 0.0, good, 1, 0.1)], STREAM + ", yaw double, flags array<boolean>, heading_carrier int, accuracy double")
    policy = composites.StereoPolicy(5, 10, 10, 1, (1.0, 0.0, 0.0))
    out = {r.row_id: r for r in composites.stereo_observations(left, right, fixes, headings, policy).collect()}
    assert {i: (r.frame, r.right_index, r.quality, r.problem) for i, r in out.items()} == {
        0: (0, 10, "rtk_fixed", None), 1: (1, 11, None, "fix"), 3: (2, 13, "invalid", "position"), 4: (3, 14, "rtk_float", "heading"), 5: (4, 15, None, "fix"),
    }
    assert (out[0].x, out[0].y, out[0].z, out[0].qz) == pytest.approx((1.0, 3.0, 3.0, np.sqrt(0.5))) and out[4].x is None
    assert composites.stereo_observations(left.limit(0), right, fixes, headings, policy).count() == 0


def test_gauges_turn_rotations_too(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(12, 3)) * 4
    rows = []
    for w in (0, 1):
        a = 2.8 * w
        turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        rows += [(1, w, f, *map(float, turn @ p[f]), 0.0, 0.0, float(np.sin(a / 2)), float(np.cos(a / 2))) for f in (range(8) if w == 0 else range(4, 12))]
    poses = spark.createDataFrame(rows, "segment_id int, window_id long, frame long, x double, y double, z double, qx double, qy double, qz double, qw double")
    for r in composites.synchronised(poses).collect():
        assert np.allclose([r.x, r.y, r.z], p[r.frame]) and abs(r.qw) == pytest.approx(1.0)


def test_plan_selects_within_the_bound(spark):
    rng = np.random.default_rng(1)
    support = [(f, float(x), float(y)) for f in range(60) for x, y in rng.normal([f % 10, 3 * (f // 10)], 0.2, (9, 2))]
    frames = spark.createDataFrame([(f, "validation" if f % 7 == 0 else "training") for f in range(60)], "frame long, role string")
    policy = scenes.PlanPolicy(planning.SplitPolicy(max_frames=20, halo=0.3), cell=0.2, min_cells=3, coverage=0.8)
    table = spark.createDataFrame(support, "frame long, x double, y double")
    plan = scenes.tile_plan(table, frames, policy)
    found = {r["name"]: r for r in plan.checks.collect()}
    assert len(found) == 7 and all(r.passed for r in found.values()), found
    rows = plan.selection.collect()
    assert len({(r.tile_id, r.frame) for r in rows}) == len(rows) and plan.tiles.count() > 1
    assert all((r.role == "validation") == (r.frame % 7 == 0) for r in rows) and {r.frame for r in rows} == set(range(60))
    blind = scenes.tile_plan(table, frames.union(spark.createDataFrame([(99, "training")], frames.schema)), policy)
    assert [(r["name"], r.value) for r in blind.checks.where("not passed").collect()] == [("all_frames_selected", 1.0)]
    with pytest.raises(ValueError, match="no support"):
        scenes.tile_plan(table.limit(0), frames, policy)


def test_depth_lands_where_it_is_projected(spark):
    cam, target = scenes.Camera(10.0, 10.0, 3.0, 3.0, 7, 7), scenes.Camera(12.0, 12.0, 4.0, 4.0, 9, 9)
    angle = 0.2
    poses = spark.createDataFrame([(1, 90, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 91, 10, 1.0, 0.0, 0.0, 0.0, 0.0, float(np.sin(angle / 2)), float(np.cos(angle / 2)))], STREAM + ", x double, y double, z double, qx double, qy double, qz double, qw double")
    depths, colors = spark.createDataFrame([(1, 1, 2), (1, 2, 90)], STREAM), spark.createDataFrame([(1, 7, 4)], STREAM)
    rng = np.random.default_rng(4)
    grid = [(1, 1, u, v, float(rng.uniform(2, 4))) for u in range(7) for v in range(7)]
    pixels = spark.createDataFrame(grid, "segment_id int, row_id long, u int, v int, z double")
    out, gates = scenes.transferred_depth(pixels, depths, colors, poses, cam, target, scenes.TransferPolicy(5, 20, 9))

    def pose(t):
        a = angle * t / 10
        return np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]), np.array([t / 10, 0, 0])

    (r, p), (q, s), want = pose(2), pose(4), {}
    for _, _, u, v, z in grid:
        x, y, w = q.T @ (r @ np.array([(u - 3) * z / 10, (v - 3) * z / 10, z]) + p - s)
        at = (round(12 * x / w + 4), round(12 * y / w + 4))
        if all(0 <= k < 9 for k in at):
            want[at] = min(w, want.get(at, np.inf))
    got = {(o.u, o.v): o.z for o in out.where("not filled").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    g = gates.first()
    assert (g.color_index, g.n_source, g.n_target) == (7, 49, len(want)) and out.where("filled").count() == 0
    assert scenes.transferred_depth(pixels.limit(0), depths, colors, poses, cam, target, scenes.TransferPolicy(5, 20))[0].count() == 0


def test_recomputed_rows_tell_what_differs(spark):
    stored = spark.createDataFrame([(1, 5, None), (2, 5, 1), (3, 5, 1), (5, None, 2)], "k int, a int, b int")
    found = spark.createDataFrame([(1, 5, None), (2, 6, 2), (4, 5, 1), (5, None, 3)], "k int, a int, b int")
    assert {r.k: r.problem for r in acceptance.recomputed(stored, found, ["k"], ["a", "b"]).collect()} == {2: "a", 3: "extra", 4: "missing", 5: "b"}


def test_observations_may_lack_optional_tables(spark, tmp_path):
    readers.publish(spark.createDataFrame([(7, 1, 10)], "segment_id long, row_id long, t_ns long"), f"{tmp_path}/frames", "segment_id")
    row = readers.observations(spark, str(tmp_path), "frames", "row_id long, t_ns long, later double").first()
    assert (row.segment_id, row.row_id, row.t_ns, row.later) == (7, 1, 10, None)
    assert readers.observations(spark, str(tmp_path), "imu", "t_ns long") is None
    with pytest.raises(AnalysisException):
        readers.observations(spark, str(tmp_path), "gnss", "t_ns long")
    with pytest.raises(ValueError, match="unknown"):
        readers.observations(spark, str(tmp_path), "radar", "t_ns long")


def test_observations_are_written_in_folders_of_many_segments(spark, tmp_path):
    from pathlib import Path

    import __spark_entry__ as entry

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = entry.queries()["src1_observations"](spark, "/root/testdata/sf0.001").count()
    assert rows > 10
    assert len(list(Path(tmp_path).glob("*/segments-*/frames/*/*.parquet"))) == 1
