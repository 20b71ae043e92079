"""Readers, headings, courses, tilt, pose interpolation and contracts."""

import math

import pytest
from pyspark.sql import Window

from tracklake.operators import tables, trajectory
from tracklake.sources import readers


def by_frame():
    return Window.partitionBy("segment_id").orderBy("frame")


def test_readers(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("12-000000034,1,2,3,0,0,0,1\n13-5,4,5,6,0,0,0,1\n")
    assert [(r.t_ns, r.tx, r.qw) for r in readers.ground_truth(spark, str(tmp_path / "gt.csv")).orderBy("t_ns").collect()] == [(12_000_000_034, 1.0, 1.0), (13_000_000_005, 4.0, 1.0)]
    (tmp_path / "tum.txt").write_text("# t x y z\n1700000000.123456789 1 2 3 0 0 0 1\n1700000001 4 5 6 0 0 0 1\n")
    assert [(r.t_ns, r.tz) for r in readers.timed_poses(spark, str(tmp_path / "tum.txt")).orderBy("t_ns").collect()] == [(1_700_000_000_123_456_789, 3.0), (1_700_000_001_000_000_000, 6.0)]


def test_publish_writes_once(spark, tmp_path):
    readers.publish(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        readers.publish(spark.range(3), str(tmp_path / "out"))


def test_lines(spark):
    df = spark.createDataFrame([(1, "a", 0.1, 2.0, 1e-7), (1, "b", 1 / 3, 0.0, 5.0)], "frame int, label string, x double, y double, z double")
    r = readers.trajectory_lines(df, "label", ["a", "b"], "frame").first()
    assert (r.a_x, r.b_z) != (None, None) and float(r.b_x) == pytest.approx(1 / 3, abs=1e-11)
    e = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c")], "p string, q string")
    assert [r.line for r in readers.pair_lines(e, "p", "q").collect()] == ["a b"]


def antennas(spark, bad_first=(), bad_second=()):
    schema = "segment_id string, row_id long, t_ns long, x double, y double, z double, var double, valid boolean"
    rows = lambda shift, north, bad: spark.createDataFrame([("a", i, int(0.2e9 * i) + shift, 0.2 * i + shift / 1e9, north, 0.0, 1e-4, i not in bad) for i in range(80)], schema)
    return rows(0, -0.4, bad_first), rows(10_000_000, 0.4, bad_second)


def test_dual_antenna(spark):
    out = trajectory.dual_antenna_heading(*antennas(spark), 0.8, 0.05, 10**9).orderBy("row_id").collect()
    assert [r.heading_valid for r in out] == [False] + [True] * 79  # nothing stands before the first row
    assert all(abs(r.heading - math.pi / 2) < 1e-9 and abs(r.length_m - 0.8) < 1e-9 for r in out[1:])
    out = trajectory.dual_antenna_heading(*antennas(spark, {10}, {30}), 0.8, 0.05, 10**9).collect()
    assert {r.row_id for r in out if not r.heading_valid} == {0, 10, 30, 31}


def test_course_and_tilt(spark):
    half = math.radians(5) / 2
    df = spark.createDataFrame([("a", i, int(0.1e9 * i), 0.0, 0.3 * i, math.sin(half), 0.0, 0.0, math.cos(half)) for i in range(20)], "segment_id string, frame long, t_ns long, x double, y double, qx double, qy double, qz double, qw double")
    out = trajectory.course(df, by_frame(), "segment_id", "t_ns", 3, 1.0).collect()
    assert all(abs(r.course - math.pi / 2) < 1e-9 for r in out) and all(r.course_valid for r in out if 1 < r.frame < 18)
    assert all(abs(r.roll) < 1e-12 and abs(r.pitch) < 1e-12 for r in trajectory.tilt(df, by_frame(), "segment_id", 5).collect())


def test_pose_half_way(spark):
    q = lambda a: (0.0, 0.0, math.sin(a / 2), math.cos(a / 2))
    poses = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 0.0, *q(0.0)), ("a", 1, 2, 2.0, 0.0, 0.0, *q(math.pi / 2))], "segment_id string, row_id long, t_ns long, x double, y double, z double, qx double, qy double, qz double, qw double")
    r = trajectory.interpolated_poses(spark.createDataFrame([("a", 0, 1)], "segment_id string, row_id long, t_ns long"), poses).first()
    assert (r.x, r.alpha) == (1.0, 0.5) and math.degrees(2 * math.acos(r.qw)) == pytest.approx(45)


def segment(spark, frames, split):
    f = spark.createDataFrame(frames, "segment_id string, frame long, t_ns long, right_t_ns long, sync_residual_ns long")
    return {r.rule: r.n for r in tables.frame_contract(f, spark.createDataFrame(split, "segment_id string, frame long, split string")).collect()}


def test_segment_contract(spark):
    good = [("a", i, i * 10**8 + 1000, i * 10**8 + 3000, 2000) for i in range(3)]
    split = [("a", 0, "train"), ("a", 1, "val"), ("a", 2, "train")]
    assert segment(spark, good, split) == {}
    assert segment(spark, [good[0], good[1], ("a", 3, *good[2][2:])], [*split[:2], ("a", 3, "train")]) == {"frames_contiguous": 1}
    assert segment(spark, [good[0], ("a", 1, 500, 2500, 2000), good[2]], split) == {"times_rise": 1}
    assert segment(spark, [good[0], (*good[1][:4], 1), good[2]], split) == {"sync_residual": 1}
    assert segment(spark, good, [*split, ("a", 2, "val")]) == {"split_covers": 1}
    assert segment(spark, good, split[:2]) == {"split_covers": 1}


def test_scene_completeness(spark):
    planned = spark.createDataFrame([(0,), (1,)], "tile_id int")
    owned = spark.createDataFrame([(0, 5), (1, 3), (-1, 2)], "tile_id int, n long")
    views = spark.createDataFrame([(1, 0.5), (2, 0.7)], "view int, metric double")
    assert all(tables.scene_completeness(planned, planned, owned, 10, views).first().asDict().values())
    r = tables.scene_completeness(planned, planned.where("tile_id = 0"), owned.where("tile_id <> 1"), 10, views.union(views)).first()
    assert not any((r.tiles_run, r.all_owned, r.each_contributes, r.views_once)) and r.metrics_finite


def test_roles(spark):
    rows = spark.createDataFrame([(1, "holdout"), (1, "holdout"), (2, "holdout"), (2, "calibration"), (3, "holdout"), (3, "none")], "frame int, role string")
    assert {r.frame: r.role for r in trajectory.united_roles(rows, "frame").collect()} == {1: "holdout", 2: "calibration", 3: "excluded"}


def test_steps_of_exactly_the_bound_pass(spark):
    from pyspark.sql import Window

    from tracklake.operators import acceptance

    # each segment makes one step of two metres, a twentieth of which is the bound
    rows = [(k, f, f, (k + 200.0 * f) / 100, 1.05 * (k + 200.0 * f) / 100, True) for k in range(200) for f in (0, 1)]
    df = spark.createDataFrame(rows, "segment_id long, frame long, t_ns long, x double, u double, inlier boolean").selectExpr("*", "0D AS y", "0D AS z", "0D AS v", "0D AS w")
    out = acceptance.path_gates(df, Window.partitionBy("segment_id").orderBy("frame"), acceptance.PathPolicy(30, 0.25, 0.02, 0.1, 2, 0.7))
    got = {(r.name, r.passed) for r in out.where("name in ('step_vector', 'step_length')").collect()}
    assert got == {("step_vector", True), ("step_length", True)}


def test_path_gates_hold_given_steps_as_they_are(spark):
    from tracklake.operators import acceptance

    # a step in the last bit over the bound fails, one of the bound passes; the longest is a segment's
    rows = [(k, f, f, 2.0, 2.0 + s, s, True) for k, s in ((0, 0.1), (1, math.nextafter(0.1, 1))) for f in range(3)]
    df = spark.createDataFrame(rows, "segment_id long, frame long, t_ns long, p double, r double, d double, inlier boolean")
    out = acceptance.path_gates(df, by_frame(), acceptance.PathPolicy(2, 0.25, 0.02, 0.1, 2, 0.7), steps=("p", "r", "d"))
    assert {r.segment_id: (r.passed, r.value) for r in out.where("name = 'step_vector'").collect()} == {0: (True, 0.1), 1: (False, math.nextafter(0.1, 1))}
    assert {r.segment_id: r.value for r in out.where("name = 'sliding_window'").collect()} == {0: 0.0, 1: 0.0}


def test_path_gates_give_what_their_sql_gives_at_the_bound(spark, tmp_path):
    import datetime
    import random

    import duckdb

    import __spark_entry__ as entry

    # the largest step of a segment is 200 in value, whose twentieth of a hundredth is the bound; every fifth segment is one row
    rng, rows = random.Random(3), []
    for k in range(300):
        low = round(rng.expovariate(0.02), 2)
        for v in [low, round(low + 200, 2), round(low + rng.uniform(1, 199), 2)][: 1 if k % 5 == 4 else 3]:
            rows.append((len(rows), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=len(rows)), k, "click", v, '{"k": %d}' % (7 if k % 2 else rng.randrange(100))))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    sql = con.sql(f"select segment_id, name, value, passed from ({entry.oracle_sql()['w19_path_gates']})").fetchall()
    found = entry.queries()["w19_path_gates"](spark, str(tmp_path)).select("segment_id", "name", "value", "passed").collect()
    assert sorted(map(tuple, found), key=str) == sorted(sql, key=str)
    assert {r[3] for r in sql if r[1] == "step_vector"} == {True, False, None}
