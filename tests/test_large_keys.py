"""Queries on rows that only larger tables have: long keys, entries that are 0, directions half a turn apart, exploded pixels."""

import datetime

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracklake.functions import keys
from tracklake.operators import cloud, robust, scans, scenes, selection


def rows_of(spark, name, folder):
    found = entry.queries()[name](spark, str(folder))
    return sorted(tuple(r) for r in found.collect())


def by_sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_long_frame_names_are_whole(spark, tmp_path):
    """F7."""
    assert spark.range(1).select(keys.frame_index(keys.frame_name(F.lit(1_234_567)))).first()[0] == 1_234_567
    spark.createDataFrame([(k, "p") for k in (7, 999_999, 1_000_000, 1_234_567)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert rows_of(spark, "g15_names_and_stamps", tmp_path) == by_sql("g15_names_and_stamps", tmp_path, "part")


def test_seconds_carry(spark, tmp_path):
    """F10."""
    spark.createDataFrame([(k, 9) for k in (7, 999_999, 1_000_000, 8_234_567)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows_of(spark, "src2_src4_stamps", tmp_path) == by_sql("src2_src4_stamps", tmp_path, "orders")


def test_bent_rotation_with_an_entry_of_zero(spark, tmp_path):
    """F8: a quarter turn about y has 0 in the first place."""
    spark.createDataFrame([(k, [0.0, 0.0, 0.0, 0.0, 0.1, 0.0], 0) for k in (4, 5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(spark, "q4_pose_valid", tmp_path) == by_sql("q4_pose_valid", tmp_path, "embeddings") == [(4, True), (5, False)]


def test_half_turns(spark, tmp_path):
    """directions that are exactly half a turn apart, where the last bit decides; from points on both sides of the centre."""
    places = []
    for k in range(100):
        for step in range(1, 40):
            for s in (0.5, 1.0, 2.0):
                d = k - 50
                x, other = 50 + s * step, (50 - step if d * (1 / s) == int(d / s) else None)
                if other is not None and 0 <= 50 - int(d / s) < 100:
                    places += [(x, k), (float(other), 50 - int(d / s))]
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), i // 2, "view", x, f'{{"k": {k}}}') for i, (x, k) in enumerate(places)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("w10_unwrapped", "w10_one_recording"):
        assert rows_of(spark, name, tmp_path) == by_sql(name, tmp_path, "events"), name


def test_exploded_pixels_are_not_broadcast(spark):
    """Spark takes exploded rows for as few bytes as those before, so it would broadcast them."""
    axis = F.sequence(F.lit(0), F.lit(8))
    pixels = spark.range(9).select(F.col("id").alias("k"), F.explode(axis).alias("u")).withColumn("v", F.explode(axis)).withColumn("z", F.lit(2.0))
    plan = cloud.holes_filled(pixels, 5, 0.1, 0.05, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    times = spark.range(9).select(F.lit(1).alias("segment_id"), F.col("id").alias("row_id"), F.col("id").alias("t_ns"))
    pixels = times.select("segment_id", "row_id", F.explode(axis).alias("u")).withColumn("v", F.explode(axis)).withColumn("z", F.lit(2.0))
    poses = times.select("*", *[F.lit(float(n == "qw")).alias(n) for n in ("x", "y", "z", "qx", "qy", "qz", "qw")])
    camera = scenes.Camera(10.0, 10.0, 4.0, 4.0, 9, 9)
    for out in scenes.transferred_depth(pixels, times, times, poses, camera, camera, scenes.TransferPolicy(5, 20)):
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
        # nothing under a broadcast is exploded
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                deep = line.index("BroadcastExchange")
                inside = next((k for k in range(at + 1, len(lines)) if len(lines[k]) - len(lines[k].lstrip(" :+-")) <= deep - 3), len(lines))
                assert not any("Generate explode(0," in x or "Generate explode([0" in x for x in lines[at:inside])


def test_hypotheses_at_once_equal_those_one_by_one():
    """the same fits, in one call for all draws of a key."""
    rng = np.random.default_rng(3)
    rows, weights = rng.normal(size=(40, 3, 6)), rng.uniform(0.5, 2, (40, 3))
    rows[5, :, :3] = np.arange(3)[:, None] * np.ones(3)  # in a line
    rows[6, :, 3:] = rows[6, :, :3] * (1, 1, -1)  # mirrored
    each = [np.concatenate([f[0].ravel(), f[1]]) for w, r in zip(weights, rows, strict=True) if (f := robust.weighted_rigid(r, w)) is not None]
    assert len(each) == 39
    assert np.allclose(robust.weighted_rigids(rows, weights), each, atol=1e-9)


def test_rows_of_one_group_stay_spread(spark):
    """whatever Spark thinks of the sizes, a group isn't brought to one task by a join on its key."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        values = spark.range(100).select(F.lit(0).alias("one_group"), F.col("id").alias("bits"))
        found = selection.ranked(values, spark.createDataFrame([(0, 7)], "one_group int, rank long"), ["one_group"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        assert found.count() == 1
    finally:
        spark.conf.set(name, before)


def tasks_of(spark, name, folder, monkeypatch):
    """Tasks that give the rows of a query if a task may hold ten rows."""
    monkeypatch.setattr(scans, "TASK_ROWS", 10)
    return entry.queries()[name](spark, str(folder)).rdd.getNumPartitions()


def test_pairs_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """the tasks of a grouping follow the rows."""
    pairs = [(k % 50, k % 3 + (k % 50 == k % 3), float(k % 50), 1) for k in range(210)]
    spark.createDataFrame([r for r in pairs if r[0] != r[1]], "l_partkey long, l_suppkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k) for k in range(40)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert tasks_of(spark, "j22_pair_evidence", tmp_path, monkeypatch) >= 20
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = [tuple(r) for r in entry.queries()["j22_pair_evidence"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(con.execute(entry.oracle_sql()["j22_pair_evidence"]).fetchall(), key=repr)


def test_trajectory_rows_are_dealt_by_number(spark, tmp_path, monkeypatch):
    """F21."""
    rows = [(k, datetime.datetime(2024, 1, 1, 0, k), k % 2, "view", float(k), f'{{"k": {k % 5}}}') for k in range(50)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert tasks_of(spark, "snk2_trajectory_lines", tmp_path, monkeypatch) == 10
    assert rows_of(spark, "snk2_trajectory_lines", tmp_path) == by_sql("snk2_trajectory_lines", tmp_path, "events")


def test_rig_images_are_dealt_by_number(spark, tmp_path, monkeypatch):
    """F26."""
    spark.createDataFrame([(k % 40, k % 3, k % 4) for k in range(200)], "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tasks_of(spark, "j25_rig_state", tmp_path, monkeypatch) == 20
    assert rows_of(spark, "j25_rig_state", tmp_path) == by_sql("j25_rig_state", tmp_path, "lineitem")
