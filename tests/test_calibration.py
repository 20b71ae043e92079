"""Calibration operators against numpy on whole arrays, and models read from text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import association, calibration
from tracklake.plans.calibration_queries import RIG_PRIOR, RIG_STEPS, rig_residual
from tracklake.sources import readers


def frame(spark, names, rows):
    return spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], names)


def kabsch(p, q):
    a, b = p.mean(0), q.mean(0)
    left, _, right = np.linalg.svd((q - b).T @ (p - a))
    r = left @ np.diag([1, 1, np.linalg.det(left @ right)]) @ right
    return r, b - r @ a


def test_colours_are_mapped_by_least_squares(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((60, 3)), rng.random((60, 3))
    a[:30, 1], view = a[:30, 0], np.repeat([0, 1], 30)  # view 0: two channels alike, so many best maps
    rows = frame(spark, "view int, i int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double", [(int(view[i]), i, *a[i], *b[i]) for i in range(60)])
    found = {r["i"]: (r["a0"], r["a1"], r["a2"]) for r in calibration.color_corrected(rows, "view", fit=F.col("i") % 5 > 0).collect()}
    for v in (0, 1):
        mine = np.flatnonzero(view == v)
        fit = mine[mine % 5 > 0]
        one = np.c_[a, np.ones(60)]
        best = np.clip(one[mine] @ np.linalg.lstsq(one[fit], b[fit], rcond=None)[0], 0, 1)
        assert np.allclose([found[i] for i in mine], best, atol=1e-7)


def test_colours_without_rows_to_fit(spark):
    rows = frame(spark, "view int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double", [(1, 0.1, 0.2, 0.3, 0.1, 0.2, 0.3)])
    assert calibration.color_corrected(rows, "view", fit=F.lit(False)).first()["a0"] is None
    assert calibration.color_corrected(rows.limit(0), "view").count() == 0


def path(t):
    return np.c_[np.sin(t), np.cos(1.7 * t), 0.1 * t]


def test_clock_profile_finds_the_offset_and_equals_numpy(spark):
    t, s = np.arange(10, 40) * 0.25, np.arange(0, 60) * 0.2
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    target = path(t + 0.4) @ turn.T + [5, 6, 7]
    reference = frame(spark, "segment_id int, row_id long, t_ns long, u double, v double, w double", [(1, i, int(t[i] * 1e9), *target[i]) for i in range(30)])
    sample = frame(spark, "segment_id int, row_id long, t_ns long, x double, y double, z double", [(1, i, int(round(s[i] * 1e9)), *path(s)[i]) for i in range(60)])
    offsets = [-800_000_000, 0, 200_000_000, 400_000_000, 600_000_000, 60_000_000_000]
    out = {r["offset_ns"]: r for r in calibration.clock_profile(reference, sample, offsets, 300_000_000).collect()}
    assert sorted(out) == offsets[:-1]  # no reference is enclosed a minute later
    for o, r in out.items():
        at = t + o / 1e9
        held = (at >= s[0]) & (at <= s[-1])
        p = np.c_[tuple(np.interp(at, s, path(s)[:, k]) for k in range(3))][held]
        rotation, move = kabsch(p, target[held])
        residual = np.linalg.norm(target[held] - p @ rotation.T - move, axis=1)
        assert (r["n"], r["cost"], r["median_m"]) == (held.sum(), pytest.approx((residual**2).mean(), abs=1e-9), pytest.approx(np.median(residual), abs=1e-7))
    best = calibration.profile_summary(frame(spark, "segment_id int, offset_ns long, cost double", [(1, o, r["cost"]) for o, r in out.items()]), "segment_id").first()
    assert best["best_offset"] == 400_000_000 and best["interior"] and best["drop"] > 0.9


def test_one_point_profile(spark):
    best = calibration.profile_summary(frame(spark, "k int, offset_ns long, cost double", [(1, 5, 2.0)]), "k").first()
    assert (best["best_offset"], best["interior"], best["drop"], best["separation"], best["prominence"]) == (5, False, 0.0, None, 0.0)


def test_observability_equals_the_whole_jacobian(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(40, 6)) * [5, 5, 2, 1, 1, 1]
    df = frame(spark, "x double, y double, z double, u double, v double, w double", rows)
    found = calibration.observability(df, rig_residual, [0.0] * 12, RIG_STEPS, RIG_PRIOR).first()
    parts = []
    for j, h in enumerate(RIG_STEPS):
        high, low = ([s * h if i == j else 0.0 for i in range(12)] for s in (1, -1))
        both = df.select(*[v.cast("double").alias(f"a{k}") for k, v in enumerate(rig_residual(high))], *[v.cast("double").alias(f"b{k}") for k, v in enumerate(rig_residual(low))]).toPandas().to_numpy()
        parts.append(((both[:, :6] - both[:, 6:]) / (2 * h)).ravel())
    jacobian = np.array(parts).T
    basis = np.linalg.svd(jacobian[:, :6], full_matrices=False)[0]
    left = (jacobian[:, 6:] - basis @ (basis.T @ jacobian[:, 6:])) * RIG_PRIOR
    sigma = np.array(RIG_PRIOR) * np.sqrt(np.diag(np.linalg.inv(left.T @ left + np.eye(6))))
    assert np.allclose(found["posterior_sigma"], sigma, rtol=1e-4)
    assert (found["n"], found["nuisance_rank"], found["rank"]) == (40, 6, 5)
    assert found["posterior_sigma"][2] == pytest.approx(RIG_PRIOR[2], rel=1e-3)  # the lever's height isn't observable


def test_folds_equal_numpy_and_small_ones_are_null(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(50, 3)) * 4
    q = p @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]).T + [1, 2, 3] + rng.normal(size=(50, 3)) * 0.1
    block = np.arange(50) % 4
    names = "field int, block int, x double, y double, z double, u double, v double, w double"
    df = frame(spark, names, [(1, int(block[i]), *p[i], *q[i]) for i in range(50)] + [(2, 0, *p[0], *q[0]), (2, 1, *p[1], *q[1])])
    out = {(r["field"], r["block"]): r for r in calibration.block_cross_validation(df, "block", "field").collect()}
    assert len(out) == 6 and out[2, 0]["median_m"] is None and out[2, 0]["n_training"] == 1
    for b in range(4):
        r, t = kabsch(p[block != b], q[block != b])
        residual = np.linalg.norm(q[block == b] - p[block == b] @ r.T - t, axis=1)
        assert (out[1, b]["median_m"], out[1, b]["p95_m"]) == (pytest.approx(np.median(residual)), pytest.approx(np.quantile(residual, 0.95)))


def test_brackets_with_and_without_a_bound_agree(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.integers(0, 10**12, 200))
    reference = frame(spark, "segment_id int, row_id long, t_ns long", [(int(i % 2), i, int(rng.integers(0, 10**12))) for i in range(150)])
    sample = frame(spark, "segment_id int, row_id long, t_ns long", [(int(i % 2), i, int(t[i])) for i in range(200)])
    gap = 8 * 10**9
    bound = {r["row_id"]: r for r in association.bracket(reference, sample, gap).collect()}
    free = {r["row_id"]: r for r in association.bracket(reference, sample).collect()}
    assert len(bound) == len(free) == 150
    for i, r in free.items():
        held = r["upper_t_ns"] is not None and r["lower_t_ns"] is not None and r["upper_t_ns"] - r["lower_t_ns"] <= gap
        assert (bound[i]["lower_index"], bound[i]["upper_index"]) == ((r["lower_index"], r["upper_index"]) if held else (None, None))


def test_models_in_text(spark, tmp_path):
    pose = lambda i, name, q="1 0 0 0": f"{i} {q} 1 2 3 1 {name}"
    one = ["# models", pose(1, "a"), "", "", pose(2, "b"), "1 2 -1", pose(3, "b"), "# between", "", pose(4, "c", "0 0 0 0"), "", "5 1 0 0", "", pose(6, "d", "1 0 x 0"), "", pose(7, "e")]
    (tmp_path / "one.txt").write_text("\n".join(one) + "\n")
    (tmp_path / "two.txt").write_text(pose(1, "a") + "\n\n")
    (tmp_path / "none.txt").write_text("")
    out = sorted((r["file"], r["name"] or "", r["x"], r["problem"]) for r in readers.pose_model(spark, str(tmp_path)).collect())
    assert [(f, n, p) for f, n, _, p in out] == [
        ("one.txt", "", "fields"), ("one.txt", "a", None), ("one.txt", "b", "repeated"), ("one.txt", "b", "repeated"), ("one.txt", "c", "quaternion"), ("one.txt", "d", "number"), ("one.txt", "e", "observations"), ("two.txt", "a", None),
    ]
    assert out[1][2] == -1.0
