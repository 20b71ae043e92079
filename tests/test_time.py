"""Associations, quality, series, jumps and keyframes: known answers and sequential restatements on random streams."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklake.operators import association as a
from tracklake.operators import jumps, keyframes, quality, series


def streams(spark, ref, smp):
    schema = "segment_id string, row_id long, t_ns long"
    return [spark.createDataFrame([(k, i, t) for k in ("a", "b") for i, t in enumerate(x)], schema) for x in (ref, smp)]


def matches(df, *columns):
    """Rows of one segment; both segments must be alike."""
    rows = {k: sorted(tuple(r[c] for c in columns) for r in df.collect() if r.segment_id == k) for k in ("a", "b")}
    assert rows["a"] == rows["b"]
    return rows["a"]


@pytest.mark.parametrize(
    ("ref", "smp", "tolerance", "expected"),
    [
        ([100, 200, 300], [90, 110, 290], 15, [(0, 0, -10), (1, None, None), (2, 2, -10)]),
        ([100, 110, 120], [105], 20, [(0, 0, 5), (1, 0, -5), (2, 0, -15)]),
        ([1, 2], [], 0, [(0, None, None), (1, None, None)]),
        ([], [1], 5, []),
        ([5], [5, 5], 0, [(0, 0, 0)]),
    ],
)
def test_nearest(spark, ref, smp, tolerance, expected):
    assert matches(a.nearest(*streams(spark, ref, smp), tolerance), "row_id", "sample_index", "residual_ns") == expected


@pytest.mark.parametrize(
    ("ref", "smp", "tolerance", "expected"),
    [([5, 6], [4, 5], 1, [(0, 0, -1), (1, 1, -1)]), ([1_000, 1_137, 1_411], [1_004, 1_140, 1_450], 5, [(0, 0, 4), (1, 1, 3)]), ([1, 2], [], 0, [])],
)
def test_one_to_one(spark, ref, smp, tolerance, expected):
    assert matches(a.one_to_one(*streams(spark, ref, smp), tolerance), "row_id", "sample_index", "residual_ns") == expected


def test_a_dense_stream_is_one_stretch(spark):
    df = streams(spark, list(range(0, 60_000, 2)), list(range(1, 60_001, 3)))
    assert matches(a.one_to_one(*df, 3), "row_id", "sample_index", "residual_ns") == greedy(list(range(0, 60_000, 2)), list(range(1, 60_001, 3)), 3)


def greedy(ref, smp, tolerance):
    out, s = [], 0
    for r, t in enumerate(ref):
        while s < len(smp) and smp[s] < t - tolerance:
            s += 1
        if s < len(smp) and smp[s] <= t + tolerance:
            out.append((r, s, smp[s] - t))
            s += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_streams(spark, seed):
    rng = random.Random(seed)
    ref, smp = (sorted(rng.randrange(4000) for _ in range(150)) for _ in range(2))
    tolerance = rng.choice([0, 3, 20])
    df = streams(spark, ref, smp)
    assert matches(a.one_to_one(*df, tolerance), "row_id", "sample_index", "residual_ns") == greedy(ref, smp, tolerance)

    def best(t):
        j = min(range(len(smp)), key=lambda j: (abs(smp[j] - t), smp[j] > t))
        return smp[j] - t

    got = matches(a.nearest_with_validity(*df, tolerance), "row_id", "residual_ns", "association_valid")
    assert got == [(i, best(t), abs(best(t)) <= tolerance) for i, t in enumerate(ref)]


def test_nearest_doesnt_depend_on_partitions(spark):
    rng = random.Random(9)
    df = streams(spark, [rng.randrange(10**12) for _ in range(300)], [rng.randrange(10**12) for _ in range(300)])
    one = matches(a.nearest(*df, 10**9), "row_id", "sample_index")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert matches(a.nearest(*df, 10**9), "row_id", "sample_index") == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bracket_and_unique(spark):
    ref, smp = streams(spark, [0, 10, 15, 20, 31], [10, 20, 30])
    values = smp.withColumn("x", F.col("t_ns") * 2.0)
    assert matches(a.interpolated(ref, values, ["x"]), "row_id", "lower_index", "upper_index", "alpha", "x") == [(0, None, None, None, None), (1, 0, 0, 0.0, 20.0), (2, 0, 1, 0.5, 30.0), (3, 1, 1, 0.0, 40.0), (4, None, None, None, None)]
    ref, smp = streams(spark, [9, 10, 12, 99], [10, 40])
    assert matches(a.unique_nearest(ref, smp, 3), "row_id", "state") == [(0, "lost"), (1, "won"), (2, "lost"), (3, "none")]


def test_receiver_modes_override_status(spark):
    rows = [(1, "SPP", 0), (2, "dgnss", 0), (3, "float-rtk", 0), (4, "FIXED_RTK", 0), (5, "FIXED_RTK", 1), (6, "magic!", 0), (7, None, 0)]
    df = spark.createDataFrame(rows, "i int, name string, error int").withColumn("mode", quality.receiver_mode(F.col("name")))
    state = quality.receiver_state(F.col("mode"), F.col("error"), F.lit(2), F.lit(True), F.lit(True))
    got = [(r.mode, r.q, r.c) for r in df.select("i", "mode", state["quality"].alias("q"), state["carrier"].alias("c")).orderBy("i").collect()]
    assert got == [("SPP", "standalone", 0), ("DGNSS", "differential", 0), ("FLOAT_RTK", "rtk_float", 1), ("FIXED_RTK", "rtk_fixed", 2), ("FIXED_RTK", "invalid", -1), ("UNRECOGNIZED:MAGIC", "invalid", -1), (None, "invalid", -1)]


def by_frame():
    return Window.partitionBy("segment_id").orderBy("frame")


def test_distance_sampler(spark):
    df = spark.createDataFrame([("a", i, 0.1 * i, 0.0, 0.0) for i in range(11)], "segment_id string, frame long, x double, y double, z double")
    got = series.sample_by_distance(df, 0.15, by_frame(), "x", "y", "z").orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 2, 3, 5, 6, 8, 9]
    assert abs(series.path_length(df, by_frame(), "x", "y", "z").agg(F.max("path_m")).first()[0] - 1.0) < 1e-12


@pytest.mark.parametrize("seed", range(3))
def test_series_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = 40
    t = np.cumsum(rng.integers(1, 9, n))
    v = rng.normal(size=n)
    df = spark.createDataFrame([("a", i, int(t[i]), float(v[i]), float(rng.uniform(-3, 3))) for i in range(n)], "segment_id string, frame long, t long, v double, angle double")
    out = series.unwrapped(series.smoothed(df, by_frame(), "segment_id", 4, "v"), by_frame(), "angle", "u").withColumn("g", series.gradient(by_frame(), "v", "t")).orderBy("frame").collect()
    padded = np.concatenate([[v[0]] * 2, v, [v[-1]] * 1])
    assert np.allclose([r.v_smooth for r in out], [padded[i : i + 4].mean() for i in range(n)])
    assert np.allclose([r.g for r in out], np.gradient(v, t.astype(float)))
    assert np.allclose([r.u for r in out], np.unwrap([r.angle for r in out]))
    picked, last = [], None
    for i, x in enumerate(t.tolist()):
        if last is None or x - last >= 11:
            picked.append(i)
            last = x
    assert sorted(r.frame for r in series.decimated(df, 11, "segment_id", "t", "frame").collect()) == picked


@pytest.mark.parametrize(("n", "rows", "shift", "rejected"), [(40, [20], (0.18, -0.01), 1), (100, [48, 49, 50, 51], (0.15, 0.02), 4), (60, [], (0, 0), 0)])
def test_jump_excursions(spark, n, rows, shift, rejected):
    data = []
    for i in range(n):
        t = 0.2 * i
        d = shift if i in rows else (0, 0)
        data.append(("a", i, int(t * 1e9), 0.12 * t + d[0], 0.03 * np.sin(0.4 * t) + d[1], 0.002 * t, 4e-6, 2, True))
    df = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in data], "segment_id string, frame long, t_ns long, x double, y double, z double, var double, carrier int, valid boolean")
    r = jumps.audit(df, jumps.JumpPolicy(max_rejected_share=0.1)).first()
    assert (r.rejected, r.excursions, r.unpaired, r.passed) == (rejected, int(bool(rows)), 0, True)
    found = jumps.excursions(jumps.boundaries(df), df).collect()
    assert [i for e in found for i in range(e.start, e.stop)] == rows


def sequential_keyframes(rows, forced, policy):
    out, last = {}, None
    for i, (x, yaw, t, fine) in enumerate(rows):
        found = set(forced.get(i, ()))
        if last is not None:
            found |= {n for n, v, bound in (("translation", abs(x - rows[last][0]), policy.translation_m), ("rotation", abs(yaw - rows[last][1]), policy.rotation_deg), ("max_elapsed", t - rows[last][2], policy.elapsed_s)) if v >= bound - 1e-9}
        if not found or (not fine and found <= {"translation", "rotation"}):
            continue
        out[i] = ",".join(r for r in keyframes.REASONS if r in found | (set() if fine else {"quality_override"}))
        last = i
    return out


@pytest.mark.parametrize("seed", range(3))
def test_keyframes(spark, seed):
    rng = random.Random(seed)
    n, x, yaw, rows = 80, 0.0, 0.0, []
    for i in range(n):
        x, yaw = x + rng.choice([0, 0.13, 0.31]), min(170.0, yaw + rng.choice([0, 0, 3.3]))
        rows.append((x, yaw, 0.2 * i, rng.random() < 0.8))
    status = [rng.choice([0, 0, 0, 0, 1]) for _ in range(n)]
    turning = [20 <= i < 26 or i == 50 for i in range(n)]
    step = [rng.random() for _ in range(n)]
    half = [np.radians(r[1]) / 2 for r in rows]
    df = spark.createDataFrame(
        [(s, i, int(r[2] * 1e9), r[0], 0.0, 0.0, 0.0, 0.0, float(np.sin(half[i])), float(np.cos(half[i])), r[3], turning[i], step[i], status[i]) for s in ("a", "b") for i, r in enumerate(rows)],
        "segment_id string, frame long, t_ns long, x double, y double, z double, qx double, qy double, qz double, qw double, acceptable boolean, turning boolean, step_deg double, status int",
    )
    forced = keyframes.forced_reasons(df)
    expected = {0: {"endpoint"}, n - 1: {"endpoint"}}
    add = lambda i, r: expected.setdefault(i, set()).add(r)
    for i in range(1, n):
        if status[i] != status[i - 1]:
            add(i - 1, "gnss_before_change")
            add(i, "gnss_state_change")
    for first, last in ((20, 25), (50, 50)):
        add(first, "turn_entry")
        add(last, "turn_exit")
        add(max(range(first, last + 1), key=lambda i: step[i]), "turn_peak")
    assert {r.frame: set(r.reasons) for r in forced.where("segment_id = 'a'").collect()} == expected
    policy = keyframes.KeyframePolicy(0.5, 10.0, 1.5)
    got = {s: {r.frame: r.reasons for r in keyframes.select_keyframes(df, forced, policy).collect() if r.segment_id == s} for s in ("a", "b")}
    assert got["a"] == got["b"] == sequential_keyframes(rows, expected, policy)
